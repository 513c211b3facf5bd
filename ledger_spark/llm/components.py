"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledger_spark.llm.common import store


def components(links: DataFrame, rounds: int | None = None, store: Callable[[DataFrame, str], DataFrame] = store) -> DataFrame:
    """(node, root) for every node of the links (a, b): the smallest node it is known to be connected with.

    With ``rounds`` the work stops early: nodes of equal root are then connected, but
    not every connected pair has an equal root yet.  Each round is written to the
    shared folder by ``store``, so lineage stays short; no node's neighbours are gathered.
    """
    edges = store(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .where("a != b").distinct(), "edges")
    seen, done = None, 0
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not mark[0] or mark == seen or done == rounds:
            break
        seen, done = mark, done + 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(least, "a").where("b != m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        edges = store(small, "edges")
    roots = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    own = edges.select(F.col("b").alias("node")).distinct().join(roots, "node", "left_anti")
    return roots.unionByName(own.select("node", F.col("node").alias("root")))
