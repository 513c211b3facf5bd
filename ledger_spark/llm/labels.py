"""Fitting a classifier on a bounded sample of labelled rows, in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_spark.llm.words import release


def fit_on_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows_per_class: tuple[int, int],
                  longest: int, id_col: str, text_col: str, fit: Callable[[pa.Array, list[int]], object]):
    """``fit(texts, labels)`` on at most ``rows_per_class`` rows of label 0 and of 1, of ``longest`` code points each.

    Rows are taken in the order of a hash of their id, so the sample is the same in
    every run.  ``learn`` (over the id column) says which rows may be learned from;
    null labels and labels without a document are passed over.  The sample, whose size
    those bounds fix, goes to one task; only the model comes to the driver.
    """
    known = labels.select(F.col(id_col), F.col(label).cast("int").alias("_label")).where(learn)
    fits = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).where(
        learn & (F.char_length("_text") <= longest))
    parts = []
    for value, most in enumerate(rows_per_class):
        some = (known.where(F.col("_label") == value).select(id_col).distinct()
                .orderBy(F.xxhash64(id_col), id_col).limit(most))
        parts.append(fits.join(F.broadcast(some), id_col).dropDuplicates([id_col])
                     .orderBy(F.xxhash64(id_col), id_col).limit(most).select("_text", F.lit(value).alias("_label")))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_label", "ascending"), ("_text", "ascending")])
        texts = pa.array(rows.column("_text").to_pylist(), pa.string())
        model = pickle.dumps(fit(texts, rows.column("_label").to_pylist()))
        release()
        return pa.table({"model": pa.array([model], pa.binary())})

    fitted = parts[0].unionByName(parts[1]).groupBy().applyInArrow(run, "model binary").collect()
    return pickle.loads(fitted[0]["model"]) if fitted else fit(pa.array([], pa.string()), [])
