"""Parquet tables of the test data set (TPC-H-like star schema plus ``events``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; callers select columns so the scan's ReadSchema stays narrow."""
    if name not in TABLES:
        raise ValueError(f"unknown table `{name}`")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
