"""Mixing sources to target weights by Pareto order sampling.

Sources, in code-point order (null last), take weights from a repeating list and
share ``share`` times all words; a target stops at ``max_repeat`` times its
source's size and the excess is shared anew by weight.  Within a source a
document's expected copies are in proportion to its weight, at most ``max_repeat``,
with what the cap leaves shared among the others so that the expected words still
add up to the target.  The weight is the number of binary digits of the document's
size, or a column's.  Whole copies are certain, and for the fraction f documents are
ranked by random odds over inclusion odds, u / (1 - u) : f / (1 - f), with u from a
hash of seed and id, so reruns agree.  The ranking is cut where the words reach the
target; one closing document then takes up what the cut leaves.

No source is sorted or summed in one task: sums go by rank bucket, and only the
bucket where the cut falls is ordered row by row.  The number of buckets follows
the number of rows.  One row per source is windowed in a single task.

Edge cases: a null text has size 0 and is taken 0 times; a null source is a
source of its own; a null id hashes as the empty text; repeated ids tie and the
row decides; sources without words have target 0; an empty table gives an empty
table; weights of a column ``weight_col`` (null, NaN or negative: 0, never taken; above
2^64: 2^64) are rounded down to an eighth of a power of two, so a source has at most
some thousand different ones.  Columns beginning with ``_mx_`` and the names
``mix_copies`` and ``mix_copy`` are reserved; others pass through ``mix_documents``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledger_spark.llm.common import WORD, store

ROWS_PER_BUCKET = 4096
LEAST_BUCKETS = 64
BROADCAST_SOURCES = 100_000     # rows of the source table; more are joined by shuffle


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from 48 bits of a hash of seed and key."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5,
                   max_repeat: float = 2.0) -> DataFrame:
    """(_mx_source, _mx_source_size, _mx_target) for (_mx_source, _mx_size) rows.

    With sources by rising cap per weight, the level of a source is what is left of
    the total when all before it are capped, per weight left; the highest of these
    levels is the one at which capping and sharing anew come to rest.
    """
    per = sizes.groupBy("_mx_source").agg(F.sum("_mx_size").alias("_mx_source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("_mx_source").asc_nulls_last()))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("w", F.element_at(listed, (((rank - 1) % len(weights)) + 1).cast("int")))
    per = per.withColumn("cap", F.col("_mx_source_size") * F.lit(float(max_repeat)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("_mx_source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    total = F.sum("_mx_source_size").over(everything) * F.lit(float(share))
    per = per.withColumn("level", (total - before) / left)
    level = F.max("level").over(everything)
    return per.withColumn("_mx_target", F.least(F.col("cap"), level * F.col("w"))).select(
        "_mx_source", "_mx_source_size", "_mx_target")


def size_weight(size: Column) -> Column:
    """The number of binary digits of a size (0: one digit)."""
    return F.char_length(F.bin(size)).cast("double")


def stepped(weight: Column) -> Column:
    """A weight rounded down to an eighth of a power of two; 0 where it is null, NaN or not above 0."""
    inside = F.least(F.greatest(weight, F.lit(2.0 ** -64)), F.lit(2.0 ** 64))
    return F.when(weight.isNull() | F.isnan(weight) | (weight <= 0), 0.0).otherwise(
        F.pow(F.lit(2.0), F.floor(F.log2(inside) * 8) / 8))


def expected_copies(rows: DataFrame, targets: DataFrame, max_repeat: float = 2.0) -> DataFrame:
    """(_mx_source, _mx_weight, _mx_source_size, _mx_target, _mx_expected), one row for each weight in a source.

    Copies are weight times a factor, at most ``max_repeat``.  The heaviest reach the cap first: were all heavier
    weights capped and the others not, the factor would be what is left of the target per weighted word left; the
    highest of these factors is the one that meets the target.
    """
    per = rows.groupBy("_mx_source", "_mx_weight").agg(F.sum("_mx_size").alias("words"))
    per = per.join(targets.withColumnRenamed("_mx_source", "s"), F.col("_mx_source").eqNullSafe(F.col("s"))).drop("s")
    order = Window.partitionBy("_mx_source").orderBy(F.desc("_mx_weight"))
    capped = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(float(max_repeat))
    left = F.sum(F.col("_mx_weight") * F.col("words")).over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("factor", F.when(left > 0, (F.col("_mx_target") - capped) / left))
    factor = F.coalesce(F.max("factor").over(Window.partitionBy("_mx_source")), F.lit(0.0))
    return per.withColumn("_mx_expected", F.greatest(F.lit(0.0), F.least(F.lit(float(max_repeat)), factor * F.col("_mx_weight")))).select(
        "_mx_source", "_mx_weight", "_mx_source_size", "_mx_target", "_mx_expected")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_repeat: float = 2.0,
             weight_col: str | None = None, seed: str = "mix", row: Column | None = None) -> DataFrame:
    """For each row (numbered by ``row``, or as read): _mx_row, _mx_id, _mx_size, _mx_source_size, _mx_target,
    _mx_expected (copies), _mx_copies."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    rows = store(docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("_mx_row"), F.col(id_col).alias("_mx_id"),
        F.col(source_col).alias("_mx_source"), size.alias("_mx_size"),
        (F.lit(None).cast("double") if weight_col is None else F.col(weight_col).cast("double")).alias("given"),
        uniform(F.col(id_col), seed).alias("u")).withColumn(
            "_mx_weight", size_weight(F.col("_mx_size")) if weight_col is None else stepped(F.col("given"))).drop("given"), "mix-rows")
    targets = source_targets(rows, weights, share, max_repeat)
    per = store(expected_copies(rows, targets, max_repeat), "mix-sources")
    few = F.broadcast if per.count() <= BROADCAST_SOURCES else (lambda df: df)
    expected = F.col("_mx_expected")
    drawn = (rows.join(few(per.withColumnRenamed("_mx_source", "s").withColumnRenamed("_mx_weight", "w")),
                       F.col("_mx_source").eqNullSafe(F.col("s")) & (F.col("_mx_weight") == F.col("w"))).drop("s", "w")
             .withColumn("copies", F.floor(expected)).withColumn("f", expected - F.floor(expected)))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("f") / (1 - F.col("f")))
    buckets = LEAST_BUCKETS
    n = rows.count()
    while buckets * ROWS_PER_BUCKET < n:
        buckets *= 2
    ranked = store(drawn.withColumn("odds", F.when((F.col("f") > 0) & (F.col("_mx_size") > 0), odds))
                   .withColumn("bucket", F.floor(F.col("odds") / (1 + F.col("odds")) * buckets))
                   .select("_mx_row", "_mx_id", "_mx_source", "_mx_size", "_mx_source_size", "_mx_target", "_mx_expected",
                           "copies", "odds", "bucket"), "mix-ranked")
    budget = ranked.groupBy("_mx_source").agg(
        (F.floor(F.max("_mx_target") + 0.5) - F.sum(F.col("copies") * F.col("_mx_size"))).alias("budget"))
    sums = ranked.where(F.col("odds").isNotNull()).groupBy("_mx_source", "bucket").agg(F.sum("_mx_size").alias("words"))
    by_bucket = Window.partitionBy("_mx_source").orderBy("bucket")
    cut = (sums.withColumn("through", F.sum("words").over(by_bucket))
           .join(budget.withColumnRenamed("_mx_source", "s"), F.col("_mx_source").eqNullSafe(F.col("s"))).drop("s")
           .where(F.col("through") > F.col("budget"))
           .groupBy("_mx_source").agg(F.min_by(F.struct("bucket", (F.col("budget") - F.col("through") + F.col("words")).alias("room")), "bucket").alias("c"))
           .select(F.col("_mx_source").alias("s"), F.col("c.bucket").alias("cut"), F.col("c.room").alias("room")))
    placed = ranked.join(few(cut), F.col("_mx_source").eqNullSafe(F.col("s")), "left").drop("s")
    at_cut = placed.where(F.col("bucket") == F.col("cut"))
    in_order = Window.partitionBy("_mx_source").orderBy("odds", "_mx_id", "_mx_row")
    running = at_cut.withColumn("run", F.sum("_mx_size").over(in_order))
    taken_at_cut = running.where(F.col("run") <= F.col("room")).select("_mx_row", "_mx_source", "_mx_size", "room")
    rest = (cut.join(taken_at_cut.groupBy("_mx_source").agg(F.sum("_mx_size").alias("used")), F.col("s").eqNullSafe(F.col("_mx_source")), "left")
            .select("s", "cut", (F.col("room") - F.coalesce("used", F.lit(0))).alias("gap")))
    later = (placed.drop("cut", "room").where(F.col("odds").isNotNull())
             .join(few(rest), F.col("_mx_source").eqNullSafe(F.col("s")))
             .where((F.col("bucket") > F.col("cut")) | (F.col("bucket") == F.col("cut")))
             .join(taken_at_cut.select("_mx_row"), "_mx_row", "left_anti"))
    miss = F.abs(F.col("gap") - F.col("_mx_size"))
    closing = (later.where(miss < F.col("gap")).groupBy("s")
               .agg(F.min_by("_mx_row", F.struct(miss, F.col("odds"), F.col("_mx_id"), F.col("_mx_row"))).alias("_mx_row")))
    chosen = taken_at_cut.select("_mx_row").unionByName(closing.select("_mx_row")).withColumn("picked", F.lit(1))
    return (placed.join(chosen, "_mx_row", "left")
            .withColumn("more", F.when(F.col("odds").isNull(), 0)
                        .when(F.col("cut").isNull() | (F.col("bucket") < F.col("cut")), 1)
                        .otherwise(F.coalesce("picked", F.lit(0))))
            .select("_mx_row", "_mx_id", "_mx_size", "_mx_source_size", "_mx_target", "_mx_expected",
                    (F.col("copies") + F.col("more")).cast("int").alias("_mx_copies")))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document once for each copy taken, with mix_copies and mix_copy (from 1).

    The numbered rows are written first, so that the plan and the mix mean the same rows.
    """
    numbered = store(docs.withColumn("_mx_row", F.monotonically_increasing_id()), "mix-documents")
    plan = plan_mix(numbered, row=F.col("_mx_row"), **options).where(F.col("_mx_copies") > 0).select("_mx_row", "_mx_copies")
    return (numbered.join(plan, "_mx_row")
            .withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mx_copies"))))
            .withColumnRenamed("_mx_copies", "mix_copies").drop("_mx_row"))
