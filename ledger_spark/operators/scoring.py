"""Batch scoring of renewal requests (M1-M7).

Each request row is validated field by field in declaration order; the first
failing field makes the row an error row (the rest of the batch is unaffected).
Valid rows get supply end, days remaining, eligibility, priority band and, if
eligible, a score and a review status.  Everything is column expressions, so a
batch of any size is one narrow pass plus the counters aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_spark.functions.rules import LOCKED_THRESHOLD, priority_band, review_status

# The request contract (field, kind, lower bound, inclusive?, upper bound)
# in declaration order, and the validation messages of the request schema.
REQUEST_FIELDS = (
    ("rx_number", "str", None, None, None),
    ("fill_date", "date", None, None, None),
    ("current_refills_remaining", "int", 0, True, None),
    ("current_quantity_billed", "float", 0, True, None),
    ("current_days_supply", "int", 0, False, None),
    ("current_refill_number", "int", 0, True, None),
    ("previous_fill_count", "int", 0, True, None),
    ("days_since_previous_fill", "float", 0, True, None),
    ("average_previous_refill_interval_days", "float", 0, True, None),
    ("std_previous_refill_interval_days", "optional_float", 0, True, None),
    ("latest_refill_timing_gap_days", "float", None, None, None),
    ("average_previous_timing_gap_days", "float", None, None, None),
    ("previous_early_fill_rate", "float", 0, True, 1),
    ("previous_on_time_fill_rate", "float", 0, True, 1),
    ("prescription_age_days", "float", 0, True, None),
    ("medication_prior_fill_count", "int", 0, True, None),
    ("medication_prior_average_days_supply", "float", 0, False, None),
    ("medication_prior_average_quantity", "float", 0, True, None),
)
MISSING_MESSAGE = {
    "str": "Input should be a valid string",
    "date": "Input should be a valid date",
    "int": "Input should be a valid integer",
    "float": "Input should be a valid number",
}
TOO_SHORT_MESSAGE = "String should have at least 1 character"
FRACTION_MESSAGE = "Input should be a valid integer, got a number with a fractional part"


def _bound_message(lower, inclusive) -> str:
    op = "greater than or equal to" if inclusive else "greater than"
    return f"Input should be {op} {lower}"


def first_validation_error() -> Column:
    """``Invalid <field>: <message>`` for the first failing field, else null (M1)."""
    expr = None
    for name, kind, lower, inclusive, upper in REQUEST_FIELDS:
        c = F.col(name)
        checks: list[tuple[Column, str]] = []
        if kind != "optional_float":
            checks.append((c.isNull(), MISSING_MESSAGE[kind]))
        if kind == "str":
            checks.append((F.length(c) < 1, TOO_SHORT_MESSAGE))
        if kind == "int":
            checks.append((c != F.floor(c), FRACTION_MESSAGE))
        if lower is not None:
            bad = (c < lower) if inclusive else (c <= lower)
            checks.append((bad, _bound_message(lower, inclusive)))
        if upper is not None:
            checks.append((c > upper, f"Input should be less than or equal to {upper}"))
        for cond, msg in checks:
            text = F.lit(f"Invalid {name}: {msg}")
            cond = F.coalesce(cond, F.lit(False))
            expr = F.when(cond, text) if expr is None else expr.when(cond, text)
    return expr


def score_batch(requests: DataFrame, as_of: Column, scorer: Callable[[], Column],
                threshold: float = LOCKED_THRESHOLD, passed: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """Per-row response or error in one projection (M1-M6); fields that no request has are refused.

    ``as_of`` is the business date column (M7), ``scorer`` builds the
    probability column from the 15 raw features (M5).  Error rows keep the
    request's ``rx_number`` and carry only ``error_code`` and ``message``.
    """
    unknown = sorted(set(requests.columns) - {f[0] for f in REQUEST_FIELDS} - set(passed))
    if unknown:
        raise ValueError(f"Requests have fields that the contract does not allow: {unknown}")
    v = requests.withColumn("_error", first_validation_error())
    valid = F.col("_error").isNull()
    supply_end = F.date_add(F.col("fill_date"), F.col("current_days_supply").cast("int"))
    days = F.datediff(supply_end, as_of)
    band = priority_band(days)
    eligible = (F.col("current_refills_remaining") == 0) & band.isNotNull()
    prob = F.when(eligible, scorer())
    prediction = F.when(eligible, (prob >= F.lit(threshold)).cast("int"))

    def ok(c: Column) -> Column:
        return F.when(valid, c)

    return v.select(
        *[c for c in requests.columns if c in passed],
        "rx_number",
        F.when(~valid, "error").when(eligible, "success").otherwise("ineligible").alias("status"),
        ok(eligible).alias("eligible"),
        ok(supply_end).alias("expected_supply_end_date"),
        ok(days).alias("days_until_supply_end"),
        ok(prob).alias("renewal_probability"),
        ok(F.lit(threshold)).alias("threshold"),
        ok(prediction).alias("prediction"),
        ok(F.when(eligible, band)).alias("priority"),
        ok(review_status(F.col("current_refills_remaining"), days, prediction)).alias("review_status"),
        F.when(~valid, "validation_error").alias("error_code"),
        F.col("_error").alias("message"),
    )


def batch_counters(results: DataFrame, keys: list[str]) -> DataFrame:
    """total, processed, failed, eligible and flagged counts per batch (M6)."""
    st = F.col("status")
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(st != "error").alias("processed"),
        F.count_if(st == "error").alias("failed"),
        F.count_if(F.coalesce(F.col("eligible"), F.lit(False))).alias("eligible_records"),
        F.count_if(F.col("prediction") == 1).alias("flagged_for_review"),
    )


def new_york_business_date(ts: Column) -> Column:
    """Calendar date in New York for a UTC timestamp (M7)."""
    return F.to_date(F.from_utc_timestamp(ts, "America/New_York"))
