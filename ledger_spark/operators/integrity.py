"""Integrity summaries of the fill history and the observation set.

Each summary is one aggregation pass (a few distinct counts at most) over the
candidate table, which already carries every fill with its history features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_spark.operators.features import FEATURE_COLUMNS, TARGET_COLUMN, eligible
from ledger_spark.operators.quantiles import exact_quantiles


def dataset_summary(candidates: DataFrame) -> DataFrame:
    """Table counts, date ranges, target balance, duplicate ids, accounting."""
    obs = eligible()
    target = F.when(obs, F.col(TARGET_COLUMN))
    n_obs = F.count_if(obs)
    pos = F.coalesce(F.sum(target), F.lit(0))
    z, c = F.col("zero_refill"), F.col("censored")
    lead, already = F.col("lead_time_ineligible"), F.col("renewal_already_received")
    return candidates.agg(
        F.countDistinct("patient_id").alias("patient_count"),
        F.countDistinct("medication_id").alias("medication_count"),
        F.countDistinct("prescription_id").alias("prescription_count"),
        F.count(F.lit(1)).alias("fill_count"),
        n_obs.alias("prediction_observation_count"),
        pos.cast("long").alias("positive_target_count"),
        (n_obs - pos).cast("long").alias("negative_target_count"),
        F.coalesce(F.try_divide(pos, n_obs), F.lit(0.0)).cast("double").alias("target_rate"),
        F.min(F.when(obs, F.col("observation_date"))).alias("observation_date_min"),
        F.max(F.when(obs, F.col("observation_date"))).alias("observation_date_max"),
        F.min("fill_date").alias("fill_date_min"),
        F.max("fill_date").alias("fill_date_max"),
        (F.count("observation_id") - F.countDistinct("observation_id")).alias("duplicate_fill_ids"),
        F.count_if(z).alias("zero_refill_candidate_count"),
        F.count_if(z & c).alias("censored_observation_count"),
        F.count_if(z & ~c & lead).alias("lead_time_ineligible_count"),
        F.count_if(z & ~c & ~lead & already).alias("renewal_already_received_count"),
    )


def fills_per_patient(fills: DataFrame) -> DataFrame:
    """Minimum, median, mean and maximum fills per patient with any fill."""
    per = fills.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))
    stats = per.agg(F.min("n").alias("minimum"), F.avg("n").alias("mean"), F.max("n").alias("maximum"))
    med = exact_quantiles(per, [], "n", {"median": 0.5})
    both = stats.unionByName(med, allowMissingColumns=True)      # two one-row frames
    return both.agg(F.max("minimum").alias("minimum"), F.max("median").alias("median"),
                    F.max("mean").alias("mean"), F.max("maximum").alias("maximum"))


def reference_issues(fills: DataFrame, prescriptions: DataFrame) -> DataFrame:
    """(prescription_id, code, rows) of every reference that does not hold.

    Both tables' keys are tagged, put together and counted per side in one aggregation, so fills of an unknown
    prescription, prescriptions without a fill and repeated prescriptions come out of one shuffle of keys.
    """
    keys = fills.select("prescription_id", F.lit(1).alias("fill"), F.lit(0).alias("rx")).unionByName(
        prescriptions.select("prescription_id", F.lit(0).alias("fill"), F.lit(1).alias("rx")))
    sides = keys.groupBy("prescription_id").agg(F.sum("fill").alias("fills"), F.sum("rx").alias("rxs"))
    codes = F.array_compact(F.array(
        F.when(F.col("rxs") == 0, F.struct(F.lit("unknown_prescription").alias("code"), F.col("fills").alias("rows"))),
        F.when(F.col("rxs") > 1, F.struct(F.lit("repeated_prescription").alias("code"), (F.col("rxs") - 1).alias("rows"))),
        F.when(F.col("fills") == 0, F.struct(F.lit("prescription_without_fill").alias("code"), F.col("rxs").alias("rows")))))
    return sides.select("prescription_id", F.explode(codes).alias("i")).select("prescription_id", "i.code", "i.rows")


def violations(fills: DataFrame, prescriptions: DataFrame) -> DataFrame:
    """Chronology and refill-accounting violations; duplicate prescription rows.

    A fill whose prescription is unknown never violates chronology (the
    comparison is false) but does violate refill accounting (null != value).
    A repeated prescription counts as a duplicate and stands once, with its
    earliest date, in the comparison: it does not multiply its fills.

    The prescriptions are derived once: each stands twice in the one join,
    to meet its fills and, without them, to give its repeats.  Fills that find
    none are those not met there, counted without a shuffle.
    """
    rx = prescriptions.groupBy("prescription_id").agg(
        F.min("prescription_date").alias("prescription_date"), F.min("refills_authorized").alias("refills_authorized"),
        F.count(F.lit(1)).alias("n")).withColumn("meets", F.explode(F.array(F.lit(True), F.lit(False))))
    f = fills.select(F.col("prescription_id").alias("_filled"), "fill_date", "refill_number", "refills_remaining")
    known, stated = F.col("_filled").isNotNull(), F.col("refills_remaining").isNotNull()
    expected = F.col("refills_authorized") - F.col("refill_number")
    met = rx.join(f, (F.col("prescription_id") == F.col("_filled")) & F.col("meets"), "left").agg(
        F.count_if(F.col("fill_date") < F.col("prescription_date")).alias("early"),
        (F.count_if(known & ~F.col("refills_remaining").eqNullSafe(expected)) - F.count_if(known & stated)).alias("unequal"),
        F.coalesce(F.sum(F.when(~F.col("meets"), F.col("n") - 1)), F.lit(0)).alias("repeats"))
    zero = F.lit(0).cast("long")
    parts = met.unionByName(fills.agg(zero.alias("early"), F.count_if(stated).alias("unequal"), zero.alias("repeats")))
    return parts.agg(F.sum("early").alias("invalid_fill_before_prescription_count"),
                     F.sum("unequal").alias("invalid_refill_accounting_count"),
                     F.sum("repeats").alias("duplicate_prescription_ids"))


def refill_timing_counts(candidates: DataFrame) -> DataFrame:
    """Early (< -1), approximately on time (-1..1) and late (> 1) refills."""
    gap = F.col("latest_refill_timing_gap_days")
    return candidates.agg(
        F.count_if(gap < -1).alias("early"),
        F.count_if(gap.between(-1, 1)).alias("approximately_on_time"),
        F.count_if(gap > 1).alias("late"),
    )


def history_counts(fills: DataFrame) -> DataFrame:
    """Histories, single-fill histories, renewed histories, additional renewals."""
    per = fills.groupBy("patient_id", "medication_id").agg(
        F.count(F.lit(1)).alias("fills"), F.countDistinct("prescription_id").alias("rx"))
    return per.agg(
        F.count(F.lit(1)).alias("patient_medication_history_count"),
        F.count_if(F.col("fills") == 1).alias("single_fill_history_count"),
        F.count_if(F.col("rx") > 1).alias("renewed_patient_medication_history_count"),
        F.sum(F.greatest(F.col("rx") - 1, F.lit(0))).alias("additional_renewal_prescription_count"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Sorted value counts, nulls ignored."""
    return (df.filter(F.col(column).isNotNull()).groupBy(column)
            .agg(F.count(F.lit(1)).alias("count")).orderBy(column))


def missing_feature_counts(observations: DataFrame) -> DataFrame:
    """Null count per feature, long form."""
    wide = observations.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in FEATURE_COLUMNS])
    return wide.unpivot([], list(FEATURE_COLUMNS), "feature", "missing_count")
