"""Writers: longitudinal tables, reports and operational workflow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType

REPORT_DECIMALS = 8


def _iso_dates(df: DataFrame) -> DataFrame:
    return df.select(*[F.date_format(f.name, "yyyy-MM-dd").alias(f.name)
                       if isinstance(f.dataType, DateType) else F.col(f.name)
                       for f in df.schema.fields])


def write_longitudinal(tables: dict[str, DataFrame], out_dir: str, summary: DataFrame | None = None,
                       fmt: str = "parquet") -> None:
    """Write each table (ISO dates in CSV) plus the integrity summary as JSON (A5)."""
    for name, df in tables.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        if fmt == "csv":
            _iso_dates(df).write.mode("overwrite").option("header", True).csv(path)
        else:
            df.write.mode("overwrite").parquet(path)
    if summary is not None:
        summary.coalesce(1).write.mode("overwrite").json(f"{out_dir.rstrip('/')}/integrity_summary")


def write_report_csv(df: DataFrame, path: str, decimals: int = REPORT_DECIMALS) -> None:
    """A report table as CSV with doubles at fixed precision."""
    fixed = df.select(*[F.format_string(f"%.{decimals}f", f.name).alias(f.name)
                        if isinstance(f.dataType, DoubleType) else F.col(f.name)
                        for f in df.schema.fields])
    _iso_dates(fixed).write.mode("overwrite").option("header", True).csv(path)


def write_report_json(df: DataFrame, path: str) -> None:
    """Nested analysis results as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_workflow_tables(predictions: DataFrame, cases: DataFrame, activities: DataFrame,
                          resolutions: DataFrame, out_dir: str, mode: str = "overwrite") -> None:
    """Operational tables as Parquet; cases partitioned by status for the work queue."""
    root = out_dir.rstrip("/")
    predictions.write.mode(mode).parquet(f"{root}/prediction_records")
    cases.write.mode(mode).partitionBy("status").parquet(f"{root}/follow_up_cases")
    activities.write.mode(mode).parquet(f"{root}/follow_up_activities")
    resolutions.write.mode(mode).parquet(f"{root}/case_resolutions")
