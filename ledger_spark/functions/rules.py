"""Column expressions for the scoring and workflow business rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Priority bands (days of supply left, inclusive) and queue rank.
PRIORITY_BANDS = (
    ("low", 8, 10),
    ("medium", 5, 7),
    ("high", 1, 4),
    ("urgent", 0, 0),
    ("urgent_overdue", -7, -1),
)
PRIORITY_RANK = ("urgent_overdue", "urgent", "high", "medium", "low")
MANUAL_REVIEW_BELOW = -7
LOCKED_THRESHOLD = 0.50


def priority_band(days: Column) -> Column:
    """Priority for the days of supply left; null outside every band (M3)."""
    expr = None
    for name, lo, hi in PRIORITY_BANDS:
        cond = days.between(lo, hi)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr


def priority_rank(priority: Column) -> Column:
    """Queue rank: urgent_overdue first, unknown last."""
    expr = None
    for i, name in enumerate(PRIORITY_RANK, start=1):
        expr = F.when(priority == name, i) if expr is None else expr.when(priority == name, i)
    return expr.otherwise(len(PRIORITY_RANK) + 1)


def review_status(refills_remaining: Column, days: Column, prediction: Column) -> Column:
    """refills_remaining / manual_review / not_in_prediction_window / prescription_review / no_review (M4)."""
    band = priority_band(days)
    return (F.when(refills_remaining != 0, "refills_remaining")
            .when(band.isNull() & (days < MANUAL_REVIEW_BELOW), "manual_review")
            .when(band.isNull(), "not_in_prediction_window")
            .when(prediction == 1, "prescription_review")
            .otherwise("no_review"))


def priority_band_sql(days: str) -> str:
    whens = " ".join(f"WHEN {days} BETWEEN {lo} AND {hi} THEN '{n}'" for n, lo, hi in PRIORITY_BANDS)
    return f"CASE {whens} END"


def priority_rank_sql(priority: str) -> str:
    whens = " ".join(f"WHEN {priority} = '{n}' THEN {i}" for i, n in enumerate(PRIORITY_RANK, start=1))
    return f"CASE {whens} ELSE {len(PRIORITY_RANK) + 1} END"
