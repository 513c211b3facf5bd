"""Medication-level inventory reconciliation for one inclusive date window."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEDICATION_KEY = ("ndc", "drug_name")
# Quantities are summed as decimals so ``net = 0`` is exact whatever order the
# shuffle delivers partial sums in; results are reported as doubles.
QUANTITY_DECIMAL = "decimal(28,6)"


def normalize_boundary(value: object, label: str) -> dt.date:
    """Accept a date, datetime or ISO string and truncate it to the day."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    try:
        return dt.date.fromisoformat(str(value).strip()[:10])
    except (TypeError, ValueError) as exc:
        raise ValueError(f"{label} must be a valid date.") from exc


def check_period(start: object, end: object) -> tuple[dt.date, dt.date]:
    start_d = normalize_boundary(start, "start_date")
    end_d = normalize_boundary(end, "end_date")
    if start_d > end_d:
        raise ValueError("start_date must be on or before end_date.")
    return start_d, end_d


def in_period(date_col: str | Column, start: dt.date, end: dt.date) -> Column:
    """Inclusive day window written as ``c >= start AND c < end + 1`` so it reaches the scan."""
    c = F.col(date_col) if isinstance(date_col, str) else date_col
    return (c >= F.lit(start)) & (c < F.lit(end + dt.timedelta(days=1)))


def filter_period(df: DataFrame, date_col: str, start: object, end: object) -> DataFrame:
    """Rows whose date falls in the inclusive window; null dates drop."""
    start_d, end_d = check_period(start, end)
    return df.filter(in_period(date_col, start_d, end_d))


def _qty(c: str) -> Column:
    return F.col(c).cast(QUANTITY_DECIMAL)


def aggregate_billing(billing: DataFrame) -> DataFrame:
    """Billed quantity per (ndc, drug_name); null keys form their own group (D3)."""
    return billing.groupBy(*MEDICATION_KEY).agg(F.sum(_qty("quantity_billed")).alias("total_billed"))


def aggregate_ordering(ordering: DataFrame) -> DataFrame:
    """Ordered quantity per (ndc, drug_name)."""
    return ordering.groupBy(*MEDICATION_KEY).agg(F.sum(_qty("quantity_ordered")).alias("total_ordered"))


def merge_sides(billing: DataFrame, ordering: DataFrame, key: tuple[str, ...] = MEDICATION_KEY) -> DataFrame:
    """Billed and ordered totals per medication, missing side = 0.

    Written as a tagged union and one aggregation instead of two aggregations
    and a full outer join: one shuffle, partial sums on the map side, and null
    keys meet each other as in the reference's merge.  Aggregating before any
    pairing also keeps several insurers from multiplying ordered quantity.
    """
    zero = F.lit(0).cast(QUANTITY_DECIMAL)
    billed = billing.select(*key, _qty("quantity_billed").alias("b"), zero.alias("o"))
    ordered = ordering.select(*key, zero.alias("b"), _qty("quantity_ordered").alias("o"))
    return billed.unionByName(ordered).groupBy(*key).agg(
        F.sum("b").alias("total_billed"), F.sum("o").alias("total_ordered"))


def inventory_status(totals: DataFrame) -> DataFrame:
    """net = ordered - billed; short / extra quantities and status."""
    net = F.col("total_ordered") - F.col("total_billed")
    return totals.select(
        *MEDICATION_KEY,
        F.col("total_billed").cast("double").alias("total_billed"),
        F.col("total_ordered").cast("double").alias("total_ordered"),
        net.cast("double").alias("net_difference"),
        F.greatest(-net, F.lit(0)).cast("double").alias("short_quantity"),
        F.greatest(net, F.lit(0)).cast("double").alias("extra_quantity"),
        F.when(net < 0, "SHORT").when(net > 0, "EXTRA").otherwise("MATCHED").alias("status"),
    )


@dataclass(frozen=True)
class Reconciliation:
    start_date: dt.date
    end_date: dt.date
    inventory: DataFrame
    billing_in_period: DataFrame
    ordering_in_period: DataFrame
    coverage: DataFrame


def reconcile_inventory(billing: DataFrame, ordering: DataFrame, start: object, end: object,
                        sort: bool = True, names: DataFrame | None = None) -> Reconciliation:
    """Inventory for the inclusive window plus the in-period inputs and coverage.

    ``billing`` / ``ordering`` are canonical, typed frames (see ``operators.validate``
    for the gate that string exports pass first).  Everything stays lazy.

    With a product master ``names`` (one ``drug_name`` per ``ndc``) the inputs
    need only ``ndc``: quantities are aggregated per code first and the names
    are attached to the aggregated rows, so no per-row name lookup is shuffled.
    Without it, grouping is on (ndc, drug_name) as given in the exports.
    """
    start_d, end_d = check_period(start, end)
    billing_p = billing.filter(in_period("billing_date", start_d, end_d))
    ordering_p = ordering.filter(in_period("ordered_date", start_d, end_d))
    if names is None:
        totals = merge_sides(billing_p, ordering_p)
    else:
        by_code = merge_sides(billing_p.select("ndc", "quantity_billed"),
                              ordering_p.select("ndc", "quantity_ordered"), ("ndc",))
        totals = by_code.join(names.select("ndc", "drug_name"), "ndc", "left")
    inventory = inventory_status(totals)
    if sort:
        inventory = inventory.orderBy(*MEDICATION_KEY)  # D7 presentation order
    return Reconciliation(start_d, end_d, inventory, billing_p, ordering_p,
                          period_coverage(billing, ordering, start_d, end_d))


def _dated_union(billing: DataFrame, ordering: DataFrame) -> DataFrame:
    return (billing.select(F.lit("billing").alias("side"), F.col("billing_date").alias("d"))
            .unionByName(ordering.select(F.lit("ordering").alias("side"),
                                         F.col("ordered_date").alias("d"))))


def period_coverage(billing: DataFrame, ordering: DataFrame, start: object, end: object) -> DataFrame:
    """Rows total / in period and in-period date range of both sides, one row."""
    start_d, end_d = check_period(start, end)
    u = _dated_union(billing, ordering)
    inside = in_period("d", start_d, end_d)
    is_b = F.col("side") == "billing"
    is_o = F.col("side") == "ordering"
    row = u.agg(
        F.count_if(is_b).alias("billing_rows_total"),
        F.count_if(is_b & inside).alias("billing_rows_in_period"),
        F.count_if(is_o).alias("ordering_rows_total"),
        F.count_if(is_o & inside).alias("ordering_rows_in_period"),
        F.min(F.when(is_b & inside, F.col("d"))).alias("billing_date_min"),
        F.max(F.when(is_b & inside, F.col("d"))).alias("billing_date_max"),
        F.min(F.when(is_o & inside, F.col("d"))).alias("ordered_date_min"),
        F.max(F.when(is_o & inside, F.col("d"))).alias("ordered_date_max"),
    )
    return row.select(
        F.lit(start_d).alias("start_date"), F.lit(end_d).alias("end_date"), "*",
        coverage_differs_materially().alias("coverage_differs_materially"),
    )


def coverage_differs_materially() -> Column:
    """Exactly one side has no dates in the window, or the two ranges are disjoint."""
    b_missing = F.col("billing_date_min").isNull()
    o_missing = F.col("ordered_date_min").isNull()
    disjoint = ((F.col("billing_date_min") > F.col("ordered_date_max"))
                | (F.col("ordered_date_min") > F.col("billing_date_max")))
    return F.when(b_missing | o_missing, b_missing != o_missing).otherwise(disjoint)


def available_date_bounds(billing: DataFrame, ordering: DataFrame) -> DataFrame:
    """Earliest and latest date over both sides, nulls ignored."""
    u = _dated_union(billing, ordering)
    return u.agg(F.min("d").alias("date_min"), F.max("d").alias("date_max"))
