"""Named queries: a Spark builder plus, where SQL can say it, a DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, DoubleType, TimestampNTZType, TimestampType

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


# Both engines round with the same IEEE operations (multiply, add one half,
# floor, divide), so equal doubles stay equal and 1-ulp differences collapse.
ROUND_LIMIT = 1e12


def _round_col(c, places: int):
    scale = float(10 ** places)
    return F.when(F.abs(c) < ROUND_LIMIT, F.floor(c * scale + 0.5) / scale).otherwise(c)


# Output normalization shared by both engines, so results compare the same
# under any hashing: dates and timestamps as ISO text, arrays as comma-joined
# text, integer columns that can be null as doubles, doubles rounded.
DATE_TEXT = "yyyy-MM-dd"
TS_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _normalize(f, places: int, nullable_ints: Sequence[str]):
    c = F.col(f.name)
    if isinstance(f.dataType, DoubleType):
        return _round_col(c, places).alias(f.name)
    if isinstance(f.dataType, DateType):
        return F.date_format(c, DATE_TEXT).alias(f.name)
    if isinstance(f.dataType, (TimestampType, TimestampNTZType)):
        return F.date_format(c, TS_TEXT).alias(f.name)
    if isinstance(f.dataType, ArrayType):
        return F.concat_ws(",", c.cast("array<string>")).alias(f.name)
    if f.name in nullable_ints:
        return _round_col(c.cast("double"), places).alias(f.name)
    return c


def rounded(df: DataFrame, places: int = 6, nullable_ints: Sequence[str] = ()) -> DataFrame:
    """Normalize every column so both sides compare on the same text and precision."""
    return df.select(*[_normalize(f, places, nullable_ints) for f in df.schema.fields])


def round_sql(body: str, double_columns: Sequence[str], places: int = 6, dates: Sequence[str] = (),
              timestamps: Sequence[str] = (), arrays: Sequence[str] = (),
              nullable_ints: Sequence[str] = ()) -> str:
    """Wrap oracle SQL so the listed columns are normalized like ``rounded``."""
    scale = f"{float(10 ** places)}::DOUBLE"

    def rnd(expr: str) -> str:
        return (f"CASE WHEN abs({expr}) < {ROUND_LIMIT}::DOUBLE THEN floor({expr} * {scale} + 0.5::DOUBLE)"
                f" / {scale} ELSE {expr} END")
    repl = [f"{rnd(f'CAST({c} AS DOUBLE)')} AS {c}" for c in (*double_columns, *nullable_ints)]
    repl += [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates]
    repl += [f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" for c in timestamps]
    repl += [f"array_to_string({c}, ',') AS {c}" for c in arrays]
    if not repl:
        return body
    return f"SELECT * REPLACE ({', '.join(repl)}) FROM (\n{body}\n) AS q"


def register(name: str, sql: str | None = None, doubles: Sequence[str] = (), *,
             dates: Sequence[str] = (), timestamps: Sequence[str] = (), arrays: Sequence[str] = (),
             nullable_ints: Sequence[str] = ()):
    """Decorator: add a (spark, sf_dir) -> DataFrame builder under ``name``.

    The oracle SQL's listed columns get the same normalization the Spark
    output gets by type (see ``rounded``).
    """
    def wrap(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        oracle = (round_sql(sql, doubles, dates=dates, timestamps=timestamps, arrays=arrays,
                            nullable_ints=nullable_ints) if sql is not None else None)
        REGISTRY[name] = Query(name, lambda spark, sf_dir: rounded(fn(spark, sf_dir),
                                                                  nullable_ints=nullable_ints),
                               oracle, (fn.__doc__ or "").strip())
        return fn
    return wrap
