"""Binary-classification evaluation over ``(label, score)`` rows.

All metrics are grouped by arbitrary key columns (model, fold, split, patient
group ...) and never need a model.  Ranking metrics use one row per distinct
score: running totals come from ``blocked_running`` with score buckets as
blocks, so neither a global window nor one task per model ever sees all scores.
Threshold sweeps bucket each row by how many grid thresholds it passes (a
column expression), aggregate map-side, and take suffix sums over <= 14 rows
per group: no cross join with the grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledger_spark.operators.scan import blocked_running

# The threshold grid and the candidate comparison thresholds.
THRESHOLD_GRID = (0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50,
                  0.55, 0.60, 0.65, 0.70, 0.75, 0.80)
COMPARISON_THRESHOLDS = (0.35, 0.40, 0.45, 0.50, 0.55)
LOCKED_THRESHOLD = 0.50
NEAR_THRESHOLD_MARGIN = 0.05
SCORE_BUCKETS = 1024


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str], bool]:
    """Ungrouped calls get a constant group so every step stays an equi-join on keys."""
    if keys:
        return df, list(keys), False
    return df.withColumn("_all", F.lit(1)), ["_all"], True


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def classification_columns(tp: Column, fp: Column, tn: Column, fn: Column) -> list[Column]:
    """Accuracy, precision, recall, F1 from counts; 0 when a denominator is 0."""
    precision = F.coalesce(_div(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(_div(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return [
        _div(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
    ]


OUTCOMES = ("TN", "FP", "FN", "TP")


def confusion_contract(df: DataFrame, expected: dict[str, int], threshold: float = LOCKED_THRESHOLD,
                       label: str = "label", score: str = "score") -> dict[str, int]:
    """The four outcome counts, 0 where there are none; raises with every count that is not the recorded one."""
    found = df.groupBy(outcome_label(threshold, label, score).alias("outcome")).agg(F.count(F.lit(1)).alias("n")).collect()   # four rows at most
    counts = dict.fromkeys(OUTCOMES, 0) | {r["outcome"]: r["n"] for r in found}
    wrong = {o: (expected.get(o, 0), counts[o]) for o in OUTCOMES if counts[o] != expected.get(o, 0)}
    if wrong:
        raise ValueError(f"Outcome counts (recorded, found) that differ: {wrong}")
    return counts


def confusion(df: DataFrame, keys: Sequence[str], threshold: float = LOCKED_THRESHOLD,
              label: str = "label", score: str = "score") -> DataFrame:
    """TN / FP / FN / TP at ``score >= threshold`` plus J2 metrics per group."""
    pred = F.col(score) >= F.lit(threshold)
    y = F.col(label) == 1
    counts = df.groupBy(*keys).agg(
        F.count_if(~pred & ~y).alias("true_negatives"),
        F.count_if(pred & ~y).alias("false_positives"),
        F.count_if(~pred & y).alias("false_negatives"),
        F.count_if(pred & y).alias("true_positives"),
    )
    tp, fp = F.col("true_positives"), F.col("false_positives")
    tn, fn = F.col("true_negatives"), F.col("false_negatives")
    return counts.select("*", *classification_columns(tp, fp, tn, fn))


def ranking_metrics(df: DataFrame, keys: Sequence[str], label: str = "label",
                    score: str = "score", many_groups: bool = False) -> DataFrame:
    """Average precision (step-wise, J3) and ROC-AUC with ties as one half (J4) per group.

    AP = sum over distinct scores s (descending) of tp_s / P * TP(>=s) / (TP(>=s) + FP(>=s)).
    AUC = sum over s of tp_s * (2 FP(<s) + fp_s), divided once by 2 P N.
    Null when a group has no positives (AP, AUC) or no negatives (AUC).
    ``many_groups`` is as in ``blocked_running``.
    """
    df, keys, dropk = _keyed(df, keys)
    per_score = df.groupBy(*keys, F.col(score).alias("_s")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_tp"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("_fp"),
    ).withColumn("_b", F.floor(F.col("_s") * SCORE_BUCKETS).cast("long"))
    j = blocked_running(per_score, keys, "_b", ["_s"],
                        sums={"_cum_tp": F.col("_tp"), "_cum_fp": F.col("_fp")}, reverse=True,
                        sum_totals={"_P": "_cum_tp", "_N": "_cum_fp"}, many_groups=many_groups)
    P, N = F.col("_P").cast("double"), F.col("_N").cast("double")
    ap_term = F.col("_tp") / P * F.col("_cum_tp") / (F.col("_cum_tp") + F.col("_cum_fp"))
    # integer numerator, one division: the AUC is the correctly rounded ratio
    auc_num = F.col("_tp") * (2 * (F.col("_N") - F.col("_cum_fp")) + F.col("_fp"))
    out = j.groupBy(*keys).agg(
        F.when(F.first("_P") > 0, F.sum(ap_term)).alias("pr_auc"),
        F.when((F.first("_P") > 0) & (F.first("_N") > 0),
               F.sum(auc_num).cast("double") / (2.0 * F.first("_P") * F.first("_N"))).alias("roc_auc"),
    )
    return out.drop("_all") if dropk else out


def _passes(score: Column, thresholds: Sequence[float]) -> Column:
    """Number of grid thresholds the score reaches (thresholds ascending)."""
    total = F.lit(0)
    for t in thresholds:
        total = total + F.when(score >= F.lit(t), 1).otherwise(0)
    return total


def threshold_sweep(df: DataFrame, keys: Sequence[str], thresholds: Sequence[float] = THRESHOLD_GRID,
                    label: str = "label", score: str = "score",
                    distinct_col: str | None = "patient_id") -> DataFrame:
    """Confusion, J2 metrics, flagged counts and operational rates per threshold.

    A row is flagged at the j-th threshold iff it passes at least j thresholds;
    a patient is flagged iff their highest-scoring row is.
    """
    df, keys, dropk = _keyed(df, keys)
    grid = sorted(thresholds)
    scored = df.withColumn("_k", _passes(F.col(score), grid))
    y = F.col(label) == 1
    per_k = scored.groupBy(*keys, "_k").agg(
        F.count_if(y).alias("_pos"), F.count_if(~y).alias("_neg"))
    if distinct_col:
        per_patient = scored.groupBy(*keys, distinct_col).agg(F.max("_k").alias("_k"))
        pk = per_patient.groupBy(*keys, "_k").agg(F.count(F.lit(1)).alias("_pat"))
        per_k = per_k.join(pk, [*keys, "_k"], "full").fillna(0, ["_pos", "_neg", "_pat"])
    else:
        per_k = per_k.withColumn("_pat", F.lit(0))
    groups = per_k.select(*keys).distinct()
    levels = groups.select(*keys, F.posexplode(F.array(*[F.lit(t) for t in grid])).alias("_j", "threshold"))
    levels = levels.withColumn("_j", F.col("_j") + 1)
    dense = levels.join(per_k.withColumnRenamed("_k", "_j"), [*keys, "_j"], "left") \
        .fillna(0, ["_pos", "_neg", "_pat"])
    # rows passing >= j thresholds = suffix sums over j (<= 13 rows per group)
    totals = per_k.groupBy(*keys).agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    suffix = (Window.partitionBy(*keys).orderBy(F.col("_j").desc())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sw = dense.select(*keys, "_j", "threshold",
                      F.sum("_pos").over(suffix).alias("true_positives"),
                      F.sum("_neg").over(suffix).alias("false_positives"),
                      F.sum("_pat").over(suffix).alias("flagged_unique_patients"))
    sw = sw.join(totals, keys, "inner")
    tp, fp = F.col("true_positives"), F.col("false_positives")
    fn, tn = F.col("_P") - tp, F.col("_N") - fp
    n = F.col("_P") + F.col("_N")
    out = sw.select(
        *keys, "threshold",
        *classification_columns(tp, fp, tn, fn),
        tp.cast("long").alias("true_positives"), fp.cast("long").alias("false_positives"),
        tn.cast("long").alias("true_negatives"), fn.cast("long").alias("false_negatives"),
        (tp + fp).cast("long").alias("flagged_observations"),
        F.col("flagged_unique_patients").cast("long").alias("flagged_unique_patients"),
        (_div(tp + fp, n) * 100).alias("flagged_percentage"),
        (_div(fn, F.col("_P")) * 100).alias("renewals_missed_per_100_actual"),
        (_div(fp, n) * 100).alias("unnecessary_followups_per_100_observations"),
    )
    if not distinct_col:
        out = out.drop("flagged_unique_patients")
    return out.drop("_all") if dropk else out


def outcome_label(threshold: float = LOCKED_THRESHOLD, label: str = "label",
                  score: str = "score") -> Column:
    """TP / FN / FP / TN per row."""
    pred = F.col(score) >= F.lit(threshold)
    y = F.col(label) == 1
    return (F.when(pred & y, "TP").when(~pred & y, "FN")
            .when(pred & ~y, "FP").otherwise("TN"))


def evaluation_summary(df: DataFrame, keys: Sequence[str], threshold: float = LOCKED_THRESHOLD,
                       label: str = "label", score: str = "score",
                       patient_col: str = "patient_id") -> DataFrame:
    """The locked-evaluation metric row per group."""
    df, keys, dropk = _keyed(df, keys)
    y = F.col(label) == 1
    pred = F.col(score) >= F.lit(threshold)
    counts = df.groupBy(*keys).agg(                     # base counts and confusion in one pass
        F.count(F.lit(1)).alias("observations"),
        F.countDistinct(patient_col).alias("unique_patients"),
        F.count_if(y).alias("positives"),
        F.count_if(~pred & ~y).alias("true_negatives"),
        F.count_if(pred & ~y).alias("false_positives"),
        F.count_if(~pred & y).alias("false_negatives"),
        F.count_if(pred & y).alias("true_positives"),
    )
    counts = counts.select("*", *classification_columns(
        F.col("true_positives"), F.col("false_positives"), F.col("true_negatives"), F.col("false_negatives")))
    j = counts.join(ranking_metrics(df, keys, label, score), keys)
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    out = j.select(
        *keys, "observations", "unique_patients", "positives",
        (F.col("observations") - F.col("positives")).alias("negatives"),
        _div(F.col("positives"), F.col("observations")).alias("positive_rate"),
        "accuracy", "precision", "recall", "f1", "pr_auc", "roc_auc",
        "true_negatives", "false_positives", "false_negatives", "true_positives",
        (tp + fp).alias("flagged_observations"),
        (_div(tp + fp, F.col("observations")) * 100).alias("flagged_percentage"),
        (_div(fn, F.col("positives")) * 100).alias("renewals_missed_per_100_actual"),
        (_div(fp, F.col("observations")) * 100).alias("unnecessary_followups_per_100_observations"),
    )
    return out.drop("_all") if dropk else out


def long_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metric rows to (keys..., metric, value) (J9 input)."""
    cast = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return cast.unpivot(list(keys), list(metrics), "metric", "value")


def stability_summary(per_fold: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, sample std, min, max of each metric across folds."""
    lf = long_metrics(per_fold, keys, metrics)
    return lf.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def matched_recall(sweep: DataFrame, reference_model: str, other_model: str,
                   thresholds: Sequence[float] = COMPARISON_THRESHOLDS,
                   model_col: str = "model_name") -> DataFrame:
    """For each reference threshold, the other model's grid row with the closest recall.

    Ties go to the first row in grid order (lowest threshold).  The pairing
    joins two fixed grids (<= 5 and 13 rows) on their comparison id; no data
    rows are paired.
    """
    ref = (sweep.filter((F.col(model_col) == reference_model)
                        & F.col("threshold").isin([float(t) for t in thresholds]))
           .select(F.col("threshold").alias("logistic_threshold"), F.col("recall").alias("_rr")))
    oth = sweep.filter(F.col(model_col) == other_model)
    cols = ["threshold", "recall", "precision", "f1", "false_positives", "false_negatives",
            "flagged_observations", "flagged_percentage"]
    pair = F.broadcast(ref.withColumn("_cmp", F.lit(1))).join(
        F.broadcast(oth.withColumn("_cmp", F.lit(1))), "_cmp")
    best = pair.groupBy("logistic_threshold").agg(
        F.min_by(F.struct(*cols), F.struct(F.abs(F.col("recall") - F.col("_rr")), F.col("threshold")))
        .alias("b"))
    chosen = best.select("logistic_threshold", F.lit(other_model).alias("model_name"), "b.*")
    own = (sweep.filter((F.col(model_col) == reference_model)
                        & F.col("threshold").isin([float(t) for t in thresholds]))
           .select(F.col("threshold").alias("logistic_threshold"),
                   F.lit(reference_model).alias("model_name"), *cols))
    return own.unionByName(chosen)
