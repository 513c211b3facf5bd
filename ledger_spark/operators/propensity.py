"""Deterministic renewal scores that need no fit (R1, and the locked linear scorer).

``renewal_propensity`` is the rule the reference's data simulator uses to
decide renewals from history known at observation time; applied to the
observation features it is a transparent score, so every evaluation operator
can be checked against SQL without fitting a model.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rule (base rate of an "Average" history, adjustments).
BASE_PROBABILITY = 0.60
ON_TIME_HIGH, ON_TIME_LOW, ON_TIME_STEP = 0.70, 0.40, 0.10
LATEST_GAP_BAND, LATEST_GAP_STEP = 1, 0.05
MANY_FILLS, SOME_FILLS, MANY_STEP, SOME_STEP = 6, 3, 0.05, 0.02


def renewal_propensity(base: float = BASE_PROBABILITY) -> Column:
    """base ± on-time-rate step ± latest-gap step + fill-count step, clamped to [0, 1]."""
    rate = F.col("previous_on_time_fill_rate")
    gap = F.col("latest_refill_timing_gap_days")
    count = F.col("previous_fill_count")
    has_gaps = rate.isNotNull()
    p = F.lit(base)
    p = p + F.when(has_gaps & (rate >= ON_TIME_HIGH), ON_TIME_STEP) \
        .when(has_gaps & (rate < ON_TIME_LOW), -ON_TIME_STEP).otherwise(0.0)
    p = p + F.when(has_gaps & (F.abs(gap) <= LATEST_GAP_BAND), LATEST_GAP_STEP) \
        .when(has_gaps & (gap > LATEST_GAP_BAND), -LATEST_GAP_STEP).otherwise(0.0)
    p = p + F.when(count >= MANY_FILLS, MANY_STEP).when(count >= SOME_FILLS, SOME_STEP).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))


def propensity_sql(base: float = BASE_PROBABILITY) -> str:
    """The same rule as a DuckDB expression in DOUBLE arithmetic (for oracles)."""
    return f"""least(1.0::DOUBLE, greatest(0.0::DOUBLE, {base}::DOUBLE
      + CASE WHEN previous_on_time_fill_rate IS NOT NULL AND previous_on_time_fill_rate >= {ON_TIME_HIGH} THEN {ON_TIME_STEP}::DOUBLE
             WHEN previous_on_time_fill_rate IS NOT NULL AND previous_on_time_fill_rate < {ON_TIME_LOW} THEN -{ON_TIME_STEP}::DOUBLE
             ELSE 0.0::DOUBLE END
      + CASE WHEN previous_on_time_fill_rate IS NOT NULL AND abs(latest_refill_timing_gap_days) <= {LATEST_GAP_BAND} THEN {LATEST_GAP_STEP}::DOUBLE
             WHEN previous_on_time_fill_rate IS NOT NULL AND latest_refill_timing_gap_days > {LATEST_GAP_BAND} THEN -{LATEST_GAP_STEP}::DOUBLE
             ELSE 0.0::DOUBLE END
      + CASE WHEN previous_fill_count >= {MANY_FILLS} THEN {MANY_STEP}::DOUBLE
             WHEN previous_fill_count >= {SOME_FILLS} THEN {SOME_STEP}::DOUBLE ELSE 0.0::DOUBLE END))"""
