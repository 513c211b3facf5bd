"""A corpus pipeline over the operators of ``ledger_spark.llm``.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage
before it kept; its result is written as Parquet and read again for the next.

toxicity          documents that score 0.7 or more go
line dedup        repeated lines go, except in the largest id that holds them
n-gram Jaccard    of each group of near duplicates (five words, 0.8) one row stays, of the smallest id
decontamination   documents that hold a benchmark window go
mixing            documents repeat as their source's target asks (mix_copies, mix_copy)

Null or empty texts pass every filter and are taken 0 times by the mix; near
duplicates go row by row, so rows that repeat an id are each judged by their own text,
and a null id counts as the largest; extra columns pass through; an empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_spark.llm import decontaminate, jaccard_join, line_dedup, mixing, toxicity
from ledger_spark.llm.common import remainder, store, table

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows outside the held-out third, like the query."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    return docs.where(toxicity.score(F.col("text"), model) < TOXIC)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(docs)
    if "n_chars" in kept.columns:
        kept = kept.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kept.schema["n_chars"].dataType), F.col("n_chars")))
    return kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # this copy of the texts lies beside the join's own tables: packed tighter than the default codec does
    rows = store(docs.withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows", compression="zstd")
    groups = (jaccard_join.near_duplicates(rows, k=5, percent=80, id_col="_row").where("cls IS NOT NULL")
              .select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")))
    named = store(groups.join(rows.select("_row", "doc_id"), "_row"), "pipeline-groups")
    first = named.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row"))
    gone = named.join(first, ["_group", "_row"], "left_anti").select("_row")
    return rows.join(gone, "_row", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bench = decontaminate.benchmark_windows(table(spark, sf_dir, "benchmark"))
    return decontaminate.remove_contaminated(docs, bench)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: The toxicity model and the components have no SQL; a test holds the near-duplicate stage against brute
#: force, the other stages are tested as operators and here for columns and row counts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
