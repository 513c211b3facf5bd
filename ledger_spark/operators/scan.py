"""Ordered running aggregates that do not put a whole group in one task.

A window ``partitionBy(group).orderBy(...)`` sends every row of a group to one
task.  When one group (a patient, a medication, a prescription number) holds a
large share of the data that task becomes the job.  The helpers here split each
group into *blocks* along the ordering (a calendar day, a score bucket), compute
block totals with a map-side-combined ``groupBy``, turn those into running
offsets with a window over the small block table, and add the offsets back to a
window that is partitioned by ``(group, block)``.  Only one block of one group
is ever ordered inside a single task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def blocked_running(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[str],
    *,
    position: str | None = None,
    sums: Mapping[str, Column] | None = None,
    previous: Mapping[str, str] | None = None,
    last_before: Mapping[str, str] | None = None,
    total: str | None = None,
    reverse: bool = False,
    sum_totals: Mapping[str, str] | None = None,
    many_groups: bool = False,
) -> DataFrame:
    """Add running aggregates over rows ordered by ``order`` within ``keys``.

    ``block`` must be a column that is non-decreasing along ``order`` (for
    example the day of a date that leads ``order``).  Adds

    * ``position``: 0-based rank of the row in its group,
    * one column per ``sums`` entry: inclusive running sum of the expression,
    * one column per ``previous`` entry: the named column's value on the
      previous row of the group (``lag``), null on the first row,
    * one column per ``last_before`` entry: the last non-null value of the
      named column on an earlier row of the group (``last ... ignore nulls``),
    * ``total``: the number of rows in the group (from the block table),
    * one column per ``sum_totals`` entry: the group's whole sum of that entry of ``sums``.

    With ``reverse=True`` the group is walked in descending order, so
    ``previous`` yields the *next* row (``lead``) and ``sums`` are suffix sums.

    ``many_groups``: the block table has many rows, so it is merged with the
    rows where they lie and never brought to the driver for a broadcast.

    Group keys must be non-null (null groups are not ordered histories).
    """
    sums, sum_totals = dict(sums or {}), dict(sum_totals or {})
    previous = dict(previous or {})
    last_before = dict(last_before or {})
    order_cols = _cols(order)
    walk = [c.desc() for c in order_cols] if reverse else order_cols
    in_block = Window.partitionBy(*keys, block).orderBy(*walk)
    running = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    local = df.select(
        "*",
        (F.row_number().over(in_block) - 1).alias("_lpos"),
        *[F.sum(expr).over(running).alias(f"_ls_{name}") for name, expr in sums.items()],
        *[F.lag(src).over(in_block).alias(f"_lp_{name}") for name, src in previous.items()],
        *[F.last(src, ignorenulls=True).over(in_block.rowsBetween(Window.unboundedPreceding, -1))
          .alias(f"_lq_{name}") for name, src in last_before.items()],
    )

    order_struct = F.struct(*order_cols)
    blocks = df.groupBy(*keys, block).agg(
        F.count(F.lit(1)).alias("_bn"),
        *[F.sum(expr).alias(f"_bs_{name}") for name, expr in sums.items()],
        *[(F.min_by if reverse else F.max_by)(F.col(src), order_struct).alias(f"_bl_{name}")
          for name, src in previous.items()],
        *[(F.min_by if reverse else F.max_by)(
            F.col(src), F.when(F.col(src).isNotNull(), order_struct)).alias(f"_bq_{name}")
          for name, src in last_before.items()],
    )
    by_block = Window.partitionBy(*keys).orderBy(F.col(block).desc() if reverse else F.col(block))
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        *keys, block,
        F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off_n"),
        *[F.coalesce(F.sum(f"_bs_{name}").over(before), F.lit(0)).alias(f"_off_{name}")
          for name in sums],
        *[F.lag(f"_bl_{name}").over(by_block).alias(f"_pb_{name}") for name in previous],
        *[F.last(f"_bq_{name}", ignorenulls=True).over(before).alias(f"_qb_{name}")
          for name in last_before],
        *([F.sum("_bn").over(Window.partitionBy(*keys)).alias("_total")] if total else []),
        *[F.sum(f"_bs_{name}").over(Window.partitionBy(*keys)).alias(f"_st_{out}") for out, name in sum_totals.items()],
    )

    joined = local.join(offsets.hint("merge") if many_groups else offsets, on=[*keys, block], how="inner")
    added = []
    if position:
        added.append((F.col("_off_n") + F.col("_lpos")).alias(position))
    if total:
        added.append(F.col("_total").alias(total))
    added += [F.col(f"_st_{out}").alias(out) for out in sum_totals]
    for name in sums:
        added.append((F.col(f"_off_{name}") + F.col(f"_ls_{name}")).alias(name))
    for name in previous:
        added.append(F.when(F.col("_lpos") == 0, F.col(f"_pb_{name}"))
                     .otherwise(F.col(f"_lp_{name}")).alias(name))
    for name in last_before:
        added.append(F.coalesce(F.col(f"_lq_{name}"), F.col(f"_qb_{name}")).alias(name))
    return joined.select(*df.columns, *added)
