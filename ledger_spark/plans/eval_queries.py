"""Registered integrity (G), preparation (H), scoring rule (R1) and evaluation (J) queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledger_spark.operators import features as fe
from ledger_spark.operators import integrity as ig
from ledger_spark.operators import metrics as me
from ledger_spark.operators import prep
from ledger_spark.operators.propensity import renewal_propensity, propensity_sql
from ledger_spark.operators.quantiles import exact_quantiles
from ledger_spark.plans.oracle import FILLS, with_
from ledger_spark.plans.registry import register
from ledger_spark.plans.research_queries import (
    LABEL_AFTER_DAYS, MODEL_AFTER_DAYS, candidates, fills, observations, observations_sql,
)
from ledger_spark.sources import derive

# Split bounds for the test data (fixed): train before 2000, validation 2000, test 2001.
BOUNDS = prep.SplitBounds(dt.date(2000, 1, 1), dt.date(2000, 12, 31), dt.date(2001, 1, 1))
SPLIT_SQL = (f"CASE WHEN observation_date < DATE '{BOUNDS.train_end_exclusive}' THEN 'train' "
             f"WHEN observation_date <= DATE '{BOUNDS.validation_end_inclusive}' THEN 'validation' "
             f"WHEN observation_date >= DATE '{BOUNDS.test_start}' THEN 'test' END")
SECOND_BASE = 0.75   # a second rule-based candidate ("consistent history" base rate)
MODELS = (("propensity_rule", 0.60), ("propensity_consistent", SECOND_BASE))
LABEL = fe.TARGET_COLUMN


def scored(spark, sf_dir, base: float = 0.60):
    """Model observations with split, label and the rule score."""
    obs = prep.chronological_split(observations(spark, sf_dir, MODEL_AFTER_DAYS), BOUNDS)
    return obs.select("*", F.col(LABEL).alias("label"), renewal_propensity(base).alias("score"))


def scored_models(spark, sf_dir):
    obs = prep.chronological_split(observations(spark, sf_dir, MODEL_AFTER_DAYS), BOUNDS)
    base = obs.select("*", F.col(LABEL).alias("label"))
    parts = [base.select("*", F.lit(name).alias("model_name"), renewal_propensity(b).alias("score"))
             for name, b in MODELS]
    return parts[0].unionByName(parts[1])


def scored_sql(select: str) -> str:
    models = " UNION ALL ".join(
        f"SELECT *, '{name}' AS model_name, {propensity_sql(b)} AS score FROM split_obs"
        for name, b in MODELS)
    return observations_sql(MODEL_AFTER_DAYS, f"""
, split_obs AS (SELECT *, {SPLIT_SQL} AS split, {LABEL} AS label FROM observations)
, scored AS (SELECT *, {propensity_sql()} AS score FROM split_obs)
, scored_models AS ({models})
{select}""")


def cands_sql(select: str, after: int = LABEL_AFTER_DAYS) -> str:
    return observations_sql(after, select)


# ---------------------------------------------------------------- G integrity
@register("g_dataset_summary", cands_sql("""
SELECT count(DISTINCT patient_id) AS patient_count,
       count(DISTINCT medication_id) AS medication_count,
       count(DISTINCT prescription_id) AS prescription_count,
       count(*) AS fill_count,
       (SELECT count(*) FROM observations) AS prediction_observation_count,
       (SELECT CAST(coalesce(sum(prescription_renewal_within_window), 0) AS BIGINT) FROM observations) AS positive_target_count,
       (SELECT CAST(count(*) - coalesce(sum(prescription_renewal_within_window), 0) AS BIGINT) FROM observations) AS negative_target_count,
       (SELECT coalesce(avg(prescription_renewal_within_window), 0.0) FROM observations) AS target_rate,
       (SELECT min(observation_date) FROM observations) AS observation_date_min,
       (SELECT max(observation_date) FROM observations) AS observation_date_max,
       min(fill_date) AS fill_date_min, max(fill_date) AS fill_date_max,
       count(fill_id) - count(DISTINCT fill_id) AS duplicate_fill_ids,
       count(*) FILTER (WHERE zero_refill) AS zero_refill_candidate_count,
       count(*) FILTER (WHERE zero_refill AND censored) AS censored_observation_count,
       count(*) FILTER (WHERE zero_refill AND NOT censored AND lead_time_ineligible) AS lead_time_ineligible_count,
       count(*) FILTER (WHERE zero_refill AND NOT censored AND NOT lead_time_ineligible
                        AND renewal_already_received) AS renewal_already_received_count
FROM candidates"""), ["target_rate"],
          dates=("observation_date_min", "observation_date_max", "fill_date_min", "fill_date_max"))
def g_dataset_summary(spark, sf_dir):
    """Counts, date ranges, target balance, duplicate ids and accounting in one row."""
    return ig.dataset_summary(candidates(spark, sf_dir, LABEL_AFTER_DAYS))


@register("g_fills_per_patient", with_(FILLS) + """
, per AS (SELECT patient_id, count(*) AS n FROM fills GROUP BY patient_id)
SELECT min(n) AS minimum, CAST(median(n) AS DOUBLE) AS median, avg(n) AS mean, max(n) AS maximum FROM per""",
          ["median", "mean"])
def g_fills_per_patient(spark, sf_dir):
    """Fills per patient: minimum, median, mean, maximum."""
    return ig.fills_per_patient(fills(spark, sf_dir))


@register("g_violations", with_(FILLS) + """
SELECT (SELECT count(*) FROM fills f LEFT JOIN prescriptions r USING (prescription_id)
        WHERE f.fill_date < r.prescription_date) AS invalid_fill_before_prescription_count,
       (SELECT count(*) FROM fills f LEFT JOIN prescriptions r USING (prescription_id)
        WHERE f.refills_remaining IS DISTINCT FROM r.refills_authorized - f.refill_number)
         AS invalid_refill_accounting_count,
       (SELECT CAST(count(*) - count(DISTINCT prescription_id) AS BIGINT) FROM prescriptions)
         AS duplicate_prescription_ids""")
def g_violations(spark, sf_dir):
    """Chronology and refill-accounting violations, duplicate prescriptions."""
    f = fills(spark, sf_dir)
    return ig.violations(f, derive.prescriptions(f))


_PLANTED_RX_SQL = """
, planted AS (
  SELECT prescription_id, CASE WHEN pn % 13 = 5 THEN CAST(prescription_date + 40 AS DATE) ELSE prescription_date END AS prescription_date,
         refills_authorized, unnest(CASE WHEN pn % 11 = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM (SELECT *, CAST(substr(patient_id, 4) AS BIGINT) AS pn FROM prescriptions) WHERE pn % 7 <> 1
  UNION ALL SELECT prescription_id || '/none', prescription_date, refills_authorized, 0
  FROM prescriptions WHERE CAST(substr(patient_id, 4) AS BIGINT) % 17 = 2)
, one AS (SELECT prescription_id, min(prescription_date) AS d, min(refills_authorized) AS a, count(*) AS n FROM planted GROUP BY 1)"""


def planted_prescriptions(f):
    """Prescriptions with planted faults by patient number: missing, repeated, dated too late, and some without fills."""
    rx, pn = derive.prescriptions(f), F.substring("patient_id", 4, 18).cast("long")

    def copy(suffix, late):
        return F.struct(F.lit(suffix).alias("suffix"), late.cast("int").alias("late"))
    own, unused = copy("", F.when(pn % 13 == 5, 40).otherwise(0)), copy("/none", F.lit(0))
    copies = F.array_compact(F.array(F.when(pn % 7 != 1, own), F.when((pn % 7 != 1) & (pn % 11 == 3), own),
                                     F.when(pn % 17 == 2, unused)))
    return rx.withColumn("_copy", F.explode(copies)).withColumns({
        "prescription_id": F.concat("prescription_id", "_copy.suffix"),
        "prescription_date": F.date_add("prescription_date", F.col("_copy.late"))}).drop("_copy")


@register("g_planted_violations", with_(FILLS) + _PLANTED_RX_SQL + """
SELECT (SELECT count(*) FROM fills f JOIN one USING (prescription_id) WHERE f.fill_date < one.d) AS invalid_fill_before_prescription_count,
       (SELECT count(*) FROM fills f LEFT JOIN one USING (prescription_id)
        WHERE f.refills_remaining IS DISTINCT FROM one.a - f.refill_number) AS invalid_refill_accounting_count,
       (SELECT CAST(sum(n - 1) AS BIGINT) FROM one) AS duplicate_prescription_ids""")
def g_planted_violations(spark, sf_dir):
    """The same counts over prescriptions with planted faults: none of them is 0."""
    f = fills(spark, sf_dir)
    return ig.violations(f, planted_prescriptions(f))


@register("g_reference_issues", with_(FILLS) + _PLANTED_RX_SQL + """
SELECT prescription_id, 'unknown_prescription' AS code, count(*) AS rows FROM fills
WHERE prescription_id NOT IN (SELECT prescription_id FROM one) GROUP BY 1
UNION ALL SELECT prescription_id, 'repeated_prescription', n - 1 FROM one WHERE n > 1
UNION ALL SELECT prescription_id, 'prescription_without_fill', n FROM one WHERE prescription_id NOT IN (SELECT prescription_id FROM fills)""")
def g_reference_issues(spark, sf_dir):
    """Unknown, repeated and unused prescriptions over planted faults, in one aggregation."""
    f = fills(spark, sf_dir)
    return ig.reference_issues(f, planted_prescriptions(f))


@register("g_refill_timing", cands_sql("""
SELECT count(*) FILTER (WHERE gap < -1) AS early,
       count(*) FILTER (WHERE gap BETWEEN -1 AND 1) AS approximately_on_time,
       count(*) FILTER (WHERE gap > 1) AS late
FROM candidates"""))
def g_refill_timing(spark, sf_dir):
    """Observed refill timing: early / on time / late."""
    return ig.refill_timing_counts(candidates(spark, sf_dir, LABEL_AFTER_DAYS))


@register("g_history_counts", with_(FILLS) + """
, per AS (SELECT patient_id, medication_id, count(*) AS fills, count(DISTINCT prescription_id) AS rx
          FROM fills GROUP BY 1, 2)
SELECT count(*) AS patient_medication_history_count,
       count(*) FILTER (WHERE fills = 1) AS single_fill_history_count,
       count(*) FILTER (WHERE rx > 1) AS renewed_patient_medication_history_count,
       CAST(sum(greatest(rx - 1, 0)) AS BIGINT) AS additional_renewal_prescription_count
FROM per""")
def g_history_counts(spark, sf_dir):
    """History counts by (patient, medication)."""
    return ig.history_counts(fills(spark, sf_dir))


@register("g_days_supply_counts", with_(FILLS) + """
SELECT days_supply, count(*) AS count FROM fills WHERE days_supply IS NOT NULL
GROUP BY days_supply ORDER BY days_supply""")
def g_days_supply_counts(spark, sf_dir):
    """Sorted value counts of days supply."""
    return ig.value_counts(fills(spark, sf_dir), "days_supply")


@register("g_missing_features", observations_sql(LABEL_AFTER_DAYS, "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS missing_count FROM observations"
    for c in fe.FEATURE_COLUMNS) + ")"))
def g_missing_features(spark, sf_dir):
    """Null count per feature, long form."""
    return ig.missing_feature_counts(observations(spark, sf_dir, LABEL_AFTER_DAYS))


# ---------------------------------------------------------------- H preparation
@register("h_split_counts", scored_sql("""
SELECT split, count(*) AS observations, CAST(sum(label) AS BIGINT) AS positives,
       min(observation_date) AS date_min, max(observation_date) AS date_max
FROM split_obs GROUP BY split"""), dates=("date_min", "date_max"))
def h_split_counts(spark, sf_dir):
    """Chronological split sizes, positives and date ranges (H1)."""
    s = prep.chronological_split(observations(spark, sf_dir, MODEL_AFTER_DAYS), BOUNDS)
    return s.groupBy("split").agg(
        F.count(F.lit(1)).alias("observations"), F.sum(LABEL).cast("long").alias("positives"),
        F.min("observation_date").alias("date_min"), F.max("observation_date").alias("date_max"))


@register("h_train_median", scored_sql("""
SELECT CAST(median(std_previous_refill_interval_days) AS DOUBLE) AS std_imputation_median
FROM split_obs WHERE split = 'train'"""), ["std_imputation_median"])
def h_train_median(spark, sf_dir):
    """Train-only exact median of the interval std (H2)."""
    s = prep.chronological_split(observations(spark, sf_dir, MODEL_AFTER_DAYS), BOUNDS)
    return prep.train_median(s)


PREPARED_COLS = ("observation_id", "split", *prep.MODEL_FEATURE_COLUMNS, LABEL)
_PREPARED_CTE = f"""
, med AS (SELECT median(std_previous_refill_interval_days) AS m FROM split_obs WHERE split = 'train')
, prepared AS (
  SELECT observation_id, split, {', '.join(c for c in fe.FEATURE_COLUMNS if c != prep.MISSING_STD_COLUMN)},
         coalesce(std_previous_refill_interval_days, (SELECT m FROM med)) AS std_previous_refill_interval_days,
         CAST(std_previous_refill_interval_days IS NOT NULL AS INTEGER) AS {prep.MISSING_STD_INDICATOR},
         {LABEL}
  FROM split_obs)"""


@register("h_prepared_features", scored_sql(
    _PREPARED_CTE + "\nSELECT " + ", ".join(PREPARED_COLS) + " FROM prepared"), fe.FEATURE_COLUMNS)
def h_prepared_features(spark, sf_dir):
    """Split, train-median imputation and availability indicator, 16 model columns (H3, H4)."""
    p = prep.prepare_temporal_dataset(observations(spark, sf_dir, MODEL_AFTER_DAYS), BOUNDS)
    return p.select(*PREPARED_COLS)


REDUCED_COLS = ("observation_id", "split", *prep.REDUCED_FEATURE_COLUMNS, LABEL)


@register("h_reduced_features", scored_sql(
    _PREPARED_CTE + "\nSELECT " + ", ".join(REDUCED_COLS) + " FROM prepared"),
    [c for c in prep.REDUCED_FEATURE_COLUMNS if c != prep.MISSING_STD_INDICATOR])
def h_reduced_features(spark, sf_dir):
    """The 11-column reduced feature set."""
    p = prep.prepare_temporal_dataset(observations(spark, sf_dir, MODEL_AFTER_DAYS), BOUNDS)
    return p.select(*REDUCED_COLS)


@register("h_scaler_stats", scored_sql(_PREPARED_CTE + "\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_pop({c}) AS std FROM prepared WHERE split = 'train'"
    for c in prep.MODEL_FEATURE_COLUMNS)), ["mean", "std"])
def h_scaler_stats(spark, sf_dir):
    """Population mean and std of each model column over train (H8)."""
    p = prep.prepare_temporal_dataset(observations(spark, sf_dir, MODEL_AFTER_DAYS), BOUNDS)
    return prep.standardization_stats(p)


@register("h_time_folds", scored_sql("""
, tr AS (SELECT observation_id, observation_date,
                row_number() OVER (ORDER BY observation_date, observation_id) - 1 AS position,
                count(*) OVER () AS n
         FROM split_obs WHERE split = 'train')
SELECT observation_id, CAST(position AS BIGINT) AS position,
       CAST(CASE WHEN n // 6 > 0 AND position >= n - 5 * (n // 6)
                 THEN (position - (n - 5 * (n // 6))) // (n // 6) + 1 ELSE 0 END AS INTEGER) AS validation_fold,
       CAST(n AS BIGINT) AS train_rows, CAST(n // 6 AS BIGINT) AS fold_size
FROM tr"""))
def h_time_folds(spark, sf_dir):
    """Expanding time folds over train: global position and validation fold (H9)."""
    s = prep.chronological_split(observations(spark, sf_dir, MODEL_AFTER_DAYS), BOUNDS)
    tf = prep.time_folds(s.filter(F.col("split") == "train"))
    return tf.select("observation_id", "position", "validation_fold", "train_rows", "fold_size")


# ---------------------------------------------------------------- R1 / J evaluation
@register("r_propensity_scores", scored_sql(
    "SELECT observation_id, split, label, score FROM scored"), ["score"])
def r_propensity_scores(spark, sf_dir):
    """Deterministic renewal propensity per observation."""
    return scored(spark, sf_dir).select("observation_id", "split", "label", "score")


_CONF = """
SELECT {keys},
       count(*) FILTER (WHERE score < {t} AND label = 0) AS true_negatives,
       count(*) FILTER (WHERE score >= {t} AND label = 0) AS false_positives,
       count(*) FILTER (WHERE score < {t} AND label = 1) AS false_negatives,
       count(*) FILTER (WHERE score >= {t} AND label = 1) AS true_positives
FROM {src} GROUP BY {keys}"""


def _j2(tp="true_positives", fp="false_positives", tn="true_negatives", fn="false_negatives") -> str:
    prec = f"coalesce(CAST({tp} AS DOUBLE) / nullif({tp} + {fp}, 0), 0.0)"
    rec = f"coalesce(CAST({tp} AS DOUBLE) / nullif({tp} + {fn}, 0), 0.0)"
    return (f"CAST({tp} + {tn} AS DOUBLE) / nullif({tp} + {fp} + {tn} + {fn}, 0) AS accuracy, "
            f"{prec} AS precision, {rec} AS recall, "
            f"coalesce(2 * {prec} * {rec} / nullif({prec} + {rec}, 0), 0.0) AS f1")


J2_COLS = ("accuracy", "precision", "recall", "f1")


@register("j_confusion_by_split", scored_sql(
    ", conf AS (" + _CONF.format(keys="split", t=me.LOCKED_THRESHOLD, src="scored") + ")\n"
    f"SELECT *, {_j2()} FROM conf"), J2_COLS)
def j_confusion_by_split(spark, sf_dir):
    """Confusion matrix and accuracy / precision / recall / F1 at 0.50 per split."""
    return me.confusion(scored(spark, sf_dir), ["split"])


def _ranking_sql(keys: str, src: str) -> str:
    return f"""
, ps AS (SELECT {keys}, score AS s, sum(label) AS tp, sum(1 - label) AS fp FROM {src} GROUP BY {keys}, score)
, cum AS (SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp,
                 sum(tp) OVER (PARTITION BY {keys}) AS p, sum(fp) OVER (PARTITION BY {keys}) AS n
          FROM ps WINDOW w AS (PARTITION BY {keys} ORDER BY s DESC))
, rank_m AS (
  SELECT {keys},
         CASE WHEN max(p) > 0 THEN sum(tp / p * ctp / (ctp + cfp)) END AS pr_auc,
         CASE WHEN max(p) > 0 AND max(n) > 0
              THEN CAST(sum(tp * (2 * (n - cfp) + fp)) AS DOUBLE) / (2.0 * max(p) * max(n)) END AS roc_auc
  FROM cum GROUP BY {keys})"""


@register("j_ranking_by_split", scored_sql(_ranking_sql("split", "scored") + "\nSELECT * FROM rank_m"),
          ["pr_auc", "roc_auc"])
def j_ranking_by_split(spark, sf_dir):
    """Step-wise average precision and ROC-AUC per split."""
    return me.ranking_metrics(scored(spark, sf_dir), ["split"])


def _sweep_sql(keys: str, src: str, patients: bool = True) -> str:
    grid = ", ".join(str(t) for t in me.THRESHOLD_GRID)
    pat = (f", count(DISTINCT CASE WHEN s.score >= g.threshold THEN s.patient_id END) AS flagged_unique_patients"
           if patients else "")
    pat_out = ", CAST(flagged_unique_patients AS BIGINT) AS flagged_unique_patients" if patients else ""
    return f"""
, grid AS (SELECT unnest([{grid}]) AS threshold)
, sw AS (
  SELECT {', '.join('s.' + k for k in keys.split(', '))}, g.threshold,
         count(*) FILTER (WHERE s.score >= g.threshold AND s.label = 1) AS true_positives,
         count(*) FILTER (WHERE s.score >= g.threshold AND s.label = 0) AS false_positives,
         count(*) FILTER (WHERE s.score < g.threshold AND s.label = 0) AS true_negatives,
         count(*) FILTER (WHERE s.score < g.threshold AND s.label = 1) AS false_negatives{pat}
  FROM {src} s, grid g GROUP BY {', '.join('s.' + k for k in keys.split(', '))}, g.threshold)
, sweep AS (
SELECT {keys}, threshold, {_j2()},
       CAST(true_positives AS BIGINT) AS true_positives, CAST(false_positives AS BIGINT) AS false_positives,
       CAST(true_negatives AS BIGINT) AS true_negatives, CAST(false_negatives AS BIGINT) AS false_negatives,
       CAST(true_positives + false_positives AS BIGINT) AS flagged_observations{pat_out},
       CAST(true_positives + false_positives AS DOUBLE) / nullif(true_positives + false_positives + true_negatives + false_negatives, 0) * 100 AS flagged_percentage,
       CAST(false_negatives AS DOUBLE) / nullif(true_positives + false_negatives, 0) * 100 AS renewals_missed_per_100_actual,
       CAST(false_positives AS DOUBLE) / nullif(true_positives + false_positives + true_negatives + false_negatives, 0) * 100
         AS unnecessary_followups_per_100_observations
FROM sw)"""


SWEEP_DOUBLES = ("threshold", *J2_COLS, "flagged_percentage", "renewals_missed_per_100_actual",
                 "unnecessary_followups_per_100_observations")


@register("j_threshold_sweep", scored_sql(
    ", val AS (SELECT * FROM scored WHERE split = 'validation')" + _sweep_sql("split", "val")
    + "\nSELECT * FROM sweep"), SWEEP_DOUBLES)
def j_threshold_sweep(spark, sf_dir):
    """13-threshold sweep on validation with flagged patients and operational rates."""
    v = scored(spark, sf_dir).filter(F.col("split") == "validation")
    return me.threshold_sweep(v, ["split"])


@register("j_candidate_points", scored_sql(
    ", val AS (SELECT * FROM scored_models WHERE split = 'validation')"
    + _sweep_sql("model_name", "val", patients=False) + "\nSELECT * FROM sweep"), SWEEP_DOUBLES)
def j_candidate_points(spark, sf_dir):
    """Operating points of two candidate scorers on validation."""
    v = scored_models(spark, sf_dir).filter(F.col("split") == "validation")
    return me.threshold_sweep(v, ["model_name"], distinct_col=None)


_MATCH_COLS = ("threshold, recall, precision, f1, false_positives, false_negatives, "
               "flagged_observations, flagged_percentage")


_CMP = ", ".join(str(t) for t in me.COMPARISON_THRESHOLDS)


@register("j_matched_recall", scored_sql(
    ", val AS (SELECT * FROM scored_models WHERE split = 'validation')"
    + _sweep_sql("model_name", "val", patients=False) + f"""
, ref AS (SELECT * FROM sweep WHERE model_name = '{MODELS[0][0]}' AND threshold IN ({_CMP}))
, oth AS (SELECT * FROM sweep WHERE model_name = '{MODELS[1][0]}')
, best AS (SELECT r.threshold AS logistic_threshold, o.*,
                  row_number() OVER (PARTITION BY r.threshold
                                     ORDER BY abs(o.recall - r.recall), o.threshold) AS rk
           FROM ref r, oth o)
SELECT threshold AS logistic_threshold, model_name, {_MATCH_COLS} FROM ref
UNION ALL
SELECT logistic_threshold, model_name, {_MATCH_COLS} FROM best WHERE rk = 1"""),
    ["logistic_threshold", "threshold", "recall", "precision", "f1", "flagged_percentage"])
def j_matched_recall(spark, sf_dir):
    """Closest-recall pairing of the second candidate to five reference thresholds."""
    v = scored_models(spark, sf_dir).filter(F.col("split") == "validation")
    sweep = me.threshold_sweep(v, ["model_name"], distinct_col=None)
    return me.matched_recall(sweep, MODELS[0][0], MODELS[1][0])


EVAL_DOUBLES = ("positive_rate", *J2_COLS, "pr_auc", "roc_auc", "flagged_percentage",
                "renewals_missed_per_100_actual", "unnecessary_followups_per_100_observations")


def _groups_spark(spark, sf_dir):
    """Validation rows, and test rows both overall and as seen / unseen patients (one pass)."""
    s = scored(spark, sf_dir)
    train_patients = s.filter(F.col("split") == "train").select("patient_id").distinct() \
        .withColumn("_seen", F.lit(True))
    ev = s.filter(F.col("split").isin("validation", "test")).join(train_patients, "patient_id", "left")
    groups = F.when(F.col("split") == "validation", F.array(F.lit("validation"))).otherwise(
        F.array(F.lit("overall"), F.when(F.col("_seen"), "seen_patients").otherwise("unseen_patients")))
    return ev.withColumn("evaluation_group", F.explode(groups)).drop("_seen")


_GROUPS_SQL = """
, trp AS (SELECT DISTINCT patient_id FROM scored WHERE split = 'train')
, grp AS (
  SELECT *, 'overall' AS evaluation_group FROM scored WHERE split = 'test'
  UNION ALL SELECT *, 'seen_patients' FROM scored WHERE split = 'test' AND patient_id IN (SELECT patient_id FROM trp)
  UNION ALL SELECT *, 'unseen_patients' FROM scored WHERE split = 'test' AND patient_id NOT IN (SELECT patient_id FROM trp)
  UNION ALL SELECT *, 'validation' FROM scored WHERE split = 'validation')"""


@register("j_locked_evaluation", scored_sql(
    _GROUPS_SQL + ", conf AS (" + _CONF.format(keys="evaluation_group", t=me.LOCKED_THRESHOLD, src="grp") + ")"
    + _ranking_sql("evaluation_group", "grp") + f"""
, base AS (SELECT evaluation_group, count(*) AS observations, count(DISTINCT patient_id) AS unique_patients,
                  count(*) FILTER (WHERE label = 1) AS positives FROM grp GROUP BY evaluation_group)
SELECT b.evaluation_group, observations, unique_patients, positives, observations - positives AS negatives,
       CAST(positives AS DOUBLE) / nullif(observations, 0) AS positive_rate, {_j2()}, pr_auc, roc_auc,
       true_negatives, false_positives, false_negatives, true_positives,
       true_positives + false_positives AS flagged_observations,
       CAST(true_positives + false_positives AS DOUBLE) / nullif(observations, 0) * 100 AS flagged_percentage,
       CAST(false_negatives AS DOUBLE) / nullif(positives, 0) * 100 AS renewals_missed_per_100_actual,
       CAST(false_positives AS DOUBLE) / nullif(observations, 0) * 100 AS unnecessary_followups_per_100_observations
FROM base b JOIN conf c USING (evaluation_group) JOIN rank_m r USING (evaluation_group)"""), EVAL_DOUBLES)
def j_locked_evaluation(spark, sf_dir):
    """Test overall / seen / unseen patients and validation metric rows."""
    return me.evaluation_summary(_groups_spark(spark, sf_dir), ["evaluation_group"])


def _outcomes(spark, sf_dir):
    s = scored(spark, sf_dir)
    train_patients = s.filter(F.col("split") == "train").select("patient_id").distinct() \
        .withColumn("seen_in_train", F.lit(True))
    test = s.filter(F.col("split") == "test").join(train_patients, "patient_id", "left") \
        .fillna(False, ["seen_in_train"])
    return test.withColumn("outcome", me.outcome_label())


_OUTCOME_SQL = f"""
, trp AS (SELECT DISTINCT patient_id FROM scored WHERE split = 'train')
, outc AS (
  SELECT *, patient_id IN (SELECT patient_id FROM trp) AS seen_in_train,
         CASE WHEN score >= {me.LOCKED_THRESHOLD} AND label = 1 THEN 'TP'
              WHEN score < {me.LOCKED_THRESHOLD} AND label = 1 THEN 'FN'
              WHEN score >= {me.LOCKED_THRESHOLD} AND label = 0 THEN 'FP' ELSE 'TN' END AS outcome
  FROM scored WHERE split = 'test')"""


@register("j_outcomes", scored_sql(_OUTCOME_SQL + "\nSELECT observation_id, patient_id, seen_in_train, "
                                   "score, label, outcome FROM outc"), ["score"])
def j_outcomes(spark, sf_dir):
    """Per-row outcome label TP / FN / FP / TN on test, with seen-in-train flag."""
    return _outcomes(spark, sf_dir).select("observation_id", "patient_id", "seen_in_train",
                                           "score", "label", "outcome")


# The features whose distribution is compared between outcomes.
ERROR_FEATURES = (
    "previous_on_time_fill_rate", "latest_refill_timing_gap_days",
    "average_previous_timing_gap_days", "previous_fill_count",
    "std_previous_refill_interval_days", "refill_interval_std_available",
    "average_previous_refill_interval_days", "medication_prior_fill_count", "prescription_age_days",
)


def _error_value(feature: str) -> str:
    """The feature as a number, in SQL that Spark and the oracle both read; the indicator is derived here."""
    source = f"{prep.MISSING_STD_COLUMN} IS NOT NULL" if feature == prep.MISSING_STD_INDICATOR else feature
    return f"CAST({source} AS DOUBLE)" if source == feature else f"CAST(CAST({source} AS INTEGER) AS DOUBLE)"


@register("j_feature_stats_by_outcome", scored_sql(_OUTCOME_SQL + "\n, lf AS (" + " UNION ALL ".join(
    f"SELECT outcome, '{c}' AS feature, {_error_value(c)} AS value FROM outc" for c in ERROR_FEATURES) + """)
SELECT outcome, feature, count(value) AS count, avg(value) AS mean,
       quantile_cont(value, 0.5) AS median, stddev_samp(value) AS std,
       quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75
FROM lf GROUP BY outcome, feature"""), ["mean", "median", "std", "q25", "q75"])
def j_feature_stats_by_outcome(spark, sf_dir):
    """count, mean, median, sample std, quartiles of key features by outcome."""
    o = _outcomes(spark, sf_dir)
    lf = o.select("outcome", *[F.expr(_error_value(c)).alias(c) for c in ERROR_FEATURES]) \
        .unpivot(["outcome"], list(ERROR_FEATURES), "feature", "value")
    stats = lf.groupBy("outcome", "feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    qs = exact_quantiles(lf, ["outcome", "feature"], "value", {"median": 0.5, "q25": 0.25, "q75": 0.75})
    return stats.join(qs, ["outcome", "feature"], "left").select(
        "outcome", "feature", "count", "mean", "median", "std", "q25", "q75")


@register("j_history_error_rates", scored_sql(_OUTCOME_SQL + """
SELECT CASE WHEN seen_in_train THEN 'seen' ELSE 'unseen' END AS patient_group,
       count(*) AS observations, count(DISTINCT patient_id) AS unique_patients,
       count(*) FILTER (WHERE outcome = 'TP') AS TP, count(*) FILTER (WHERE outcome = 'FP') AS FP,
       count(*) FILTER (WHERE outcome = 'TN') AS TN, count(*) FILTER (WHERE outcome = 'FN') AS FN,
       CAST(count(*) FILTER (WHERE outcome IN ('FP', 'FN')) AS DOUBLE) / count(*) AS error_rate,
       CAST(count(*) FILTER (WHERE outcome = 'FN') AS DOUBLE)
         / nullif(count(*) FILTER (WHERE outcome IN ('TP', 'FN')), 0) AS false_negative_rate,
       CAST(count(*) FILTER (WHERE outcome = 'FP') AS DOUBLE)
         / nullif(count(*) FILTER (WHERE outcome IN ('TN', 'FP')), 0) AS false_positive_rate
FROM outc GROUP BY 1"""), ["error_rate", "false_negative_rate", "false_positive_rate"])
def j_history_error_rates(spark, sf_dir):
    """Error, false-negative and false-positive rates for seen vs unseen patients."""
    o = _outcomes(spark, sf_dir)
    oc = F.col("outcome")
    n = F.count_if
    g = o.groupBy(F.when(F.col("seen_in_train"), "seen").otherwise("unseen").alias("patient_group")).agg(
        F.count(F.lit(1)).alias("observations"), F.countDistinct("patient_id").alias("unique_patients"),
        n(oc == "TP").alias("TP"), n(oc == "FP").alias("FP"), n(oc == "TN").alias("TN"), n(oc == "FN").alias("FN"))
    def d(a, b):
        return F.try_divide(a.cast("double"), b.cast("double"))
    return g.select("*", d(F.col("FP") + F.col("FN"), F.col("observations")).alias("error_rate"),
                    d(F.col("FN"), F.col("TP") + F.col("FN")).alias("false_negative_rate"),
                    d(F.col("FP"), F.col("TN") + F.col("FP")).alias("false_positive_rate"))


@register("j_probability_quantiles", scored_sql(_OUTCOME_SQL + """
SELECT outcome, count(*) AS count, avg(score) AS mean,
       quantile_cont(score, 0.10) AS q10, quantile_cont(score, 0.25) AS q25,
       quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q75,
       quantile_cont(score, 0.90) AS q90, min(score) AS min, max(score) AS max
FROM outc GROUP BY outcome"""), ["mean", "q10", "q25", "median", "q75", "q90", "min", "max"])
def j_probability_quantiles(spark, sf_dir):
    """Score distribution per outcome: mean, deciles, quartiles, range."""
    o = _outcomes(spark, sf_dir)
    g = o.groupBy("outcome").agg(F.count(F.lit(1)).alias("count"), F.avg("score").alias("mean"),
                                 F.min("score").alias("min"), F.max("score").alias("max"))
    qs = exact_quantiles(o, ["outcome"], "score",
                         {"q10": 0.10, "q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.90})
    return g.join(qs, "outcome", "left").select(
        "outcome", "count", "mean", "q10", "q25", "median", "q75", "q90", "min", "max")


@register("j_error_confidence", scored_sql(_OUTCOME_SQL + f"""
SELECT outcome, count(*) AS errors,
       count(*) FILTER (WHERE abs(score - {me.LOCKED_THRESHOLD}) <= {me.NEAR_THRESHOLD_MARGIN}) AS near_threshold,
       100.0 * count(*) FILTER (WHERE abs(score - {me.LOCKED_THRESHOLD}) <= {me.NEAR_THRESHOLD_MARGIN}) / count(*)
         AS near_threshold_percentage,
       count(*) FILTER (WHERE NOT abs(score - {me.LOCKED_THRESHOLD}) <= {me.NEAR_THRESHOLD_MARGIN}) AS higher_confidence,
       100.0 * count(*) FILTER (WHERE NOT abs(score - {me.LOCKED_THRESHOLD}) <= {me.NEAR_THRESHOLD_MARGIN}) / count(*)
         AS higher_confidence_percentage
FROM outc WHERE outcome IN ('FN', 'FP') GROUP BY outcome"""),
          ["near_threshold_percentage", "higher_confidence_percentage"])
def j_error_confidence(spark, sf_dir):
    """Share of errors within 0.05 of the threshold."""
    o = _outcomes(spark, sf_dir).filter(F.col("outcome").isin("FN", "FP"))
    near = F.abs(F.col("score") - F.lit(me.LOCKED_THRESHOLD)) <= F.lit(me.NEAR_THRESHOLD_MARGIN)
    return o.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("errors"), F.count_if(near).alias("near_threshold"),
        (100.0 * F.count_if(near) / F.count(F.lit(1))).alias("near_threshold_percentage"),
        F.count_if(~near).alias("higher_confidence"),
        (100.0 * F.count_if(~near) / F.count(F.lit(1))).alias("higher_confidence_percentage"))


FOLD_METRICS = ("positive_rate", "pr_auc", "roc_auc", "precision", "recall", "f1", "accuracy",
                "false_positives", "false_negatives")


def _fold_rows(spark, sf_dir):
    s = scored(spark, sf_dir)
    tf = prep.time_folds(s.filter(F.col("split") == "train"))
    return tf.filter(F.col("validation_fold") > 0).withColumnRenamed("validation_fold", "fold")


def _fold_table(spark, sf_dir):
    rows = _fold_rows(spark, sf_dir)
    ev = me.evaluation_summary(rows, ["fold"])
    sizes = rows.groupBy("fold").agg(
        F.min("position").alias("train_observations"), F.count(F.lit(1)).alias("validation_observations"))
    return sizes.join(ev, "fold").select(
        "fold", "train_observations", "validation_observations", "positive_rate", "pr_auc", "roc_auc",
        "precision", "recall", "f1", "accuracy", "true_positives", "false_positives",
        "true_negatives", "false_negatives")


_FOLDS_SQL = f"""
, tr AS (SELECT *, row_number() OVER (ORDER BY observation_date, observation_id) - 1 AS position,
                count(*) OVER () AS n FROM scored WHERE split = 'train')
, fr AS (SELECT *, CAST((position - (n - 5 * (n // 6))) // (n // 6) + 1 AS INTEGER) AS fold
         FROM tr WHERE n // 6 > 0 AND position >= n - 5 * (n // 6))
, conf AS ({_CONF.format(keys="fold", t=me.LOCKED_THRESHOLD, src="fr")})
{_ranking_sql("fold", "fr")}
, folds AS (
  SELECT f.fold, min(position) AS train_observations, count(*) AS validation_observations,
         avg(label) AS positive_rate
  FROM fr f GROUP BY f.fold)
, fold_table AS (
  SELECT folds.fold, train_observations, validation_observations, positive_rate, pr_auc, roc_auc,
         {_j2()}, true_positives, false_positives, true_negatives, false_negatives
  FROM folds JOIN conf USING (fold) JOIN rank_m USING (fold))"""


@register("j_fold_stability", scored_sql(_FOLDS_SQL + "\nSELECT * FROM fold_table"),
          ["positive_rate", "pr_auc", "roc_auc", *J2_COLS])
def j_fold_stability(spark, sf_dir):
    """Per-fold sizes, positive rate, AP, AUC and J1/J2 on expanding train folds."""
    return _fold_table(spark, sf_dir)


@register("j_stability_summary", scored_sql(_FOLDS_SQL + "\n, lf AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM fold_table" for m in FOLD_METRICS) + """)
SELECT metric, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max
FROM lf GROUP BY metric"""), ["mean", "std", "min", "max"])
def j_stability_summary(spark, sf_dir):
    """Mean, sample std, min and max of each fold metric."""
    ft = _fold_table(spark, sf_dir).withColumn("_m", F.lit(1))
    return me.stability_summary(ft, ["_m"], FOLD_METRICS).drop("_m")


@register("j_train_validation_gap", scored_sql(
    ", conf AS (" + _CONF.format(keys="split", t=me.LOCKED_THRESHOLD, src="scored") + ")"
    + _ranking_sql("split", "scored") + f"""
, m AS (SELECT split, {_j2()}, pr_auc, roc_auc FROM conf JOIN rank_m USING (split))
SELECT t.pr_auc - v.pr_auc AS pr_auc_gap, t.roc_auc - v.roc_auc AS roc_auc_gap,
       t.f1 - v.f1 AS f1_gap, t.recall - v.recall AS recall_gap
FROM m t JOIN m v ON t.split = 'train' AND v.split = 'validation'"""),
          ["pr_auc_gap", "roc_auc_gap", "f1_gap", "recall_gap"])
def j_train_validation_gap(spark, sf_dir):
    """Train minus validation metric gaps."""
    s = scored(spark, sf_dir)
    m = me.confusion(s, ["split"]).join(me.ranking_metrics(s, ["split"]), "split")
    t = m.filter(F.col("split") == "train").withColumn("_k", F.lit(1)).alias("t")
    v = m.filter(F.col("split") == "validation").withColumn("_k", F.lit(1)).alias("v")
    j = t.join(v, "_k")
    return j.select(*[(F.col(f"t.{c}") - F.col(f"v.{c}")).alias(f"{c}_gap")
                      for c in ("pr_auc", "roc_auc", "f1", "recall")])
