"""Running numbers within groups, without a window over a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledger_spark.llm.common import store

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str, at: str) -> tuple[DataFrame, DataFrame]:
    """The rows with ``at``, their number (from 0) within their group by ``order``, and the size of every group.

    Rows are dealt by ranges of (group, order), so a group that holds a third of all rows lies in many tasks; rows
    that tie in everything are dealt by their place in the input.  The sorted rows are written once.  A group's
    share of each partition is consecutive there, so its numbers follow from one count per (group, partition).
    Null keys are a group of their own.
    """
    keys = [F.col(c).asc_nulls_first() for c in group] + order + [F.col("_nr_tie")]
    rows = store(df.withColumn("_nr_tie", F.monotonically_increasing_id()).repartitionByRange(*keys)
                 .sortWithinPartitions(*keys).drop("_nr_tie").withColumn("_nr_id", F.monotonically_increasing_id())
                 .withColumn("_nr_part", F.shiftright("_nr_id", _ROW_BITS)), name)
    shares = rows.groupBy(*group, "_nr_part").agg(F.min("_nr_id").alias("_nr_first"), F.count("*").alias("_nr_n"))
    before = Window.partitionBy(*group).orderBy("_nr_part").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select(*[F.col(c).alias(f"_nr_{c}") for c in group], F.col("_nr_part").alias("_nr_of"),
                           (F.coalesce(F.sum("_nr_n").over(before), F.lit(0)) - F.col("_nr_first")).alias("_nr_shift"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_nr_{c}")) for c in group],
                  F.col("_nr_part") == F.col("_nr_of"))
    out = rows.join(shares, same).withColumn(at, F.col("_nr_id") + F.col("_nr_shift")).select(*df.columns, at)
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n"))
    return out, sizes
