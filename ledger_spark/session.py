"""Spark session defaults and lineage helpers.

Nothing here hard-codes a cluster: on a cluster the session already exists and
its configuration wins.  ``get_session`` only fills in values that are unset,
which is what the tests and the local bench need.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings applied only when the running session has no value of its own.
LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "ledger_spark") -> SparkSession:
    """Return the active session, or build a local one for tests and the bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.driver.memory", os.environ.get("LEDGER_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    The cluster's ``spark.checkpoint.dir`` comes first, then a folder set with
    ``SparkContext.setCheckpointDir``.  Only a local master may fall back to a
    folder of this machine; a cluster without a shared folder is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ledger-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never a local checkpoint).

    Used before iterative work (model fits, repeated scans) so a lost executor
    re-reads the checkpoint instead of replaying the whole derivation.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, name: str, mode: str = "overwrite",
                partition_by: list[str] | None = None, compression: str | None = None,
                buckets: tuple[int, list[str]] | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    ``buckets`` = (number, columns) of a ``df`` that is already dealt so: one file
    a bucket, and what is read back needs no exchange for work by these columns.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    key = uuid.uuid4().hex[:8]
    path = f"{root.rstrip('/')}/tables/{name}-{key}"
    writer = df.write.mode(mode)
    if compression:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if buckets:
        stored = f"ledger_{re.sub(r'[^0-9a-z]+', '_', name.lower())}_{key}"
        writer.bucketBy(buckets[0], *buckets[1]).option("path", path).format("parquet").saveAsTable(stored)
        return spark.table(stored)
    writer.parquet(path)
    return spark.read.parquet(path)


@contextmanager
def co_partitioned(spark: SparkSession) -> Iterator[None]:
    """Joins planned in the block take sides that are dealt alike by some of the join keys as they lie."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, was)


_MATERIALIZED: dict[tuple, DataFrame] = {}


def materialized(spark: SparkSession, key: tuple, build: Callable[[], DataFrame], compression: str | None = None,
                 buckets: tuple[int, list[str]] | None = None) -> DataFrame:
    """Write a shared derived table once per session (Parquet in the checkpoint folder).

    Derived tables with many consumers (the fill history, the observation
    candidates) are written once and read back, so each consumer scans a
    column-pruned Parquet table instead of replaying the derivation; the
    written copy also survives executor loss.  Set ``LEDGER_MATERIALIZE=0``
    to run every query from the raw tables.  ``buckets`` is as in ``write_table``.
    """
    if os.environ.get("LEDGER_MATERIALIZE", "1") == "0":
        return build()
    full_key = (spark.sparkContext.applicationId, *key)
    if full_key not in _MATERIALIZED:
        name = "-".join(str(k).strip("/").replace("/", "_") for k in key)
        _MATERIALIZED[full_key] = write_table(build(), name, compression=compression, buckets=buckets)
    return _MATERIALIZED[full_key]
