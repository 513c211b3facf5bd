"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_spark.session import ensure_checkpoint_dir, write_table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a derived table to the shared checkpoint folder and read it back."""
    return write_table(df, f"llm-{name}", compression=compression)


class Scratch:
    """Written tables that only the work inside a ``with`` block reads; they are deleted at its end.

    What the block returns must not read them any more: store it outside, or bring it to the driver.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.name = f"llm_{name}_{uuid.uuid4().hex[:8]}"
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{self.name}"
        self.tables: list[str] = []

    def __enter__(self) -> "Scratch":
        return self

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def bucketed(self, df: DataFrame, buckets: int, by: list[str], order: list[str]) -> DataFrame:
        """``df``, already partitioned by ``by`` into ``buckets``, as one sorted file a bucket."""
        name = f"{self.name}_{len(self.tables)}"
        self.tables.append(name)
        (df.write.bucketBy(buckets, *by).sortBy(*order).option("path", f"{self.folder}/{name}")
         .format("parquet").saveAsTable(name))
        return self.spark.table(name)

    def __exit__(self, *error) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """A-Z as a-z, all else kept.  Pure ASCII takes the quick built-in; ``lower`` alone would change É too."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor
