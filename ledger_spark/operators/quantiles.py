"""Exact quantiles with linear interpolation, without a group in one task.

``percentile`` / ``median`` merge a map of every distinct value of a group in
one task.  Here the distinct values are counted with a map-side-combined
``groupBy``, their ranks come from a blocked running sum (value buckets as
blocks), and the two values around each requested rank are picked with a
conditional aggregate.  The result is the interpolated quantile of pandas,
DuckDB ``quantile_cont`` and Spark ``percentile``: position ``(n - 1) * q``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_spark.operators.scan import blocked_running

BUCKET_LIMIT = 1e15


def _bucket(v: Column) -> Column:
    """A monotone block id for a value (integer part, clipped to stay a long)."""
    clipped = F.least(F.greatest(v, F.lit(-BUCKET_LIMIT)), F.lit(BUCKET_LIMIT))
    return F.floor(clipped).cast("long")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: Mapping[str, float], count_name: str | None = None) -> DataFrame:
    """One row per group of ``keys`` with one column per entry of ``probs``; nulls are skipped."""
    keys = list(keys)
    const = not keys
    if const:
        df, keys = df.withColumn("_all", F.lit(1)), ["_all"]
    v = F.col(value).cast("double")
    counts = (df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("_v"))
              .agg(F.count(F.lit(1)).alias("_c")))
    counts = counts.withColumn("_b", _bucket(F.col("_v")))
    ranked = blocked_running(counts, keys, "_b", ["_v"], sums={"_cum": F.col("_c")}, total="_rows")
    # _rows counts distinct values; the number of values is the last running sum
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    j = ranked.join(totals, keys, "inner")
    first = F.col("_cum") - F.col("_c")          # rank of the value's first copy
    last = F.col("_cum") - 1
    aggs, outs = [], []
    for i, (name, q) in enumerate(probs.items()):
        h = (F.col("_n") - 1) * F.lit(float(q))
        lo, hi = F.floor(h), F.ceil(h)
        aggs += [F.max(F.when((first <= lo) & (lo <= last), F.col("_v"))).alias(f"_lo{i}"),
                 F.max(F.when((first <= hi) & (hi <= last), F.col("_v"))).alias(f"_hi{i}"),
                 F.first(h - lo).alias(f"_fr{i}")]
        outs.append((F.col(f"_lo{i}") + F.col(f"_fr{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(name))
    res = j.groupBy(*keys).agg(*aggs, F.first("_n").alias("_n"))
    if count_name:
        outs.append(F.col("_n").alias(count_name))
    if not const:
        return res.select(*keys, *outs)
    # ungrouped: always one row (nulls when there is no value), like an aggregate
    names = list(probs) + ([count_name] if count_name else [])
    return res.select(*outs).agg(*[F.max(n).alias(n) for n in names])


def exact_median(df: DataFrame, value: str) -> float | None:
    """The exact median of one column as a Python value (one small action)."""
    return exact_quantiles(df, [], value, {"m": 0.5}).first()["m"]
