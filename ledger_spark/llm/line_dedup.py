"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches, those with the largest ids first, so a line's keeper
is known from its first batch on.  A batch's line keys are merge-anti-joined with
the runs' settled keys (already in ``min_docs`` documents: nothing later can
change their fate), and what is left becomes the batch's own run.  When ``fanout``
runs stand on a level they are merged into one run of the next, so later batches
meet compacted runs.  Keys, batches and runs are bucketed by key and sorted in the
shared folder: neither the anti-joins nor the merges shuffle anything.  A line's key
is the line without blanks at both ends, A-Z as a-z; the runs hold 96 bits of hash,
the number of documents and the largest id.

There are at least ``LEAST_BATCHES`` batches and one for every ``DOCS_PER_BATCH``
documents.  Up to ``BROADCAST_KEYS`` settled keys go out to the tasks that rewrite the
texts; more are joined to the documents by id.  Runs are deleted after their last use.

Keys of at least ``min_chars`` code points that occur in at least ``min_docs``
documents lose all their lines except in the largest id that holds them.

Edge cases: a null or empty text is one empty line; a null id is one document
below all others; rows that repeat an id are one document; lines repeated inside
the keeper stay; an empty table gives an empty table; extra columns pass through
(names that begin with ``_ld_`` are reserved, and ``n_lines`` and ``n_dropped`` with
``counts``); ids must be integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_spark.llm.common import BLANKS, Scratch, ascii_lower, store

LEAST_BATCHES = 6
DOCS_PER_BATCH = 1 << 24
DOCS_PER_BUCKET = 1 << 17
LEAST_BUCKETS = 8
FANOUT = 2
BROADCAST_KEYS = 1 << 19
KEY = ["h1", "h2"]
LOWEST = -(1 << 63)


def _doc(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.hash(key).alias("h2"))


def _keyed(text: Column, min_chars: int) -> Column:
    """For each line: the hash of its key, or null where the key is too short."""
    keys = F.transform(_lines(ascii_lower(F.coalesce(text, F.lit("")))), lambda x: F.btrim(x, F.lit(BLANKS)))
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, _hash(k)))


class LevelledRuns:
    """Runs of (h1, h2, docs, keeper), bucketed and sorted by key; levels of up to ``fanout`` runs, merged upwards."""

    def __init__(self, scratch: Scratch, buckets: int, min_docs: int = 3, fanout: int = FANOUT):
        self.scratch, self.buckets, self.min_docs, self.fanout = scratch, buckets, min_docs, max(fanout, 2)
        self.levels: list[list[DataFrame]] = [[]]
        self.compactions = 0

    def _runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _written(self, run: DataFrame) -> DataFrame:
        return self.scratch.bucketed(run.select(*KEY, "docs", "keeper"), self.buckets, KEY, KEY)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Merge join, run by run.  (A union would claim its children's buckets but not line them up.)"""
        every = runs[0]
        for run in runs[1:]:
            other = run.select(*KEY, F.col("docs").alias("docs2"), F.col("keeper").alias("keeper2")).hint("merge")
            every = every.join(other, KEY, "full").select(
                *KEY, (F.coalesce("docs", F.lit(0)) + F.coalesce("docs2", F.lit(0))).alias("docs"),
                F.greatest("keeper", "keeper2").alias("keeper"))
        return every

    def unsettled(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` (bucketed like the runs) whose keys no run has settled."""
        for run in self._runs():
            batch = batch.join(run.where(F.col("docs") >= self.min_docs).select(*KEY).hint("merge"), KEY, "left_anti")
        return batch

    def add(self, batch: DataFrame, last: bool = False) -> None:
        """Add a batch of (h1, h2, docs, keeper), one row a key, of documents with ids below those added before."""
        self.levels[0].append(self._written(self.unsettled(batch)))
        level = 0
        while not last and len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self._written(self._merged(self.levels[level])), []
            self.compactions += 1
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            level += 1

    def settled(self) -> DataFrame:
        """(h1, h2, keeper) of the keys in at least ``min_docs`` documents; the runs become one, the latest first."""
        runs = self._runs()
        while len(runs) > 1:
            runs = [self._written(self._merged(runs[:2])), *runs[2:]]
        self.levels = [runs]
        return runs[0].where(F.col("docs") >= self.min_docs).select(*KEY, "keeper")


def _exploded(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, h1, h2), one row for each row's distinct key."""
    keys = F.array_distinct(F.filter(_keyed(F.col(text_col), min_chars), lambda k: k.isNotNull()))
    return docs.select(_doc(id_col).alias("doc"), F.explode(keys).alias("k")).select("doc", "k.h1", "k.h2")


def settled_keys(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
                 min_docs: int = 3, batches: int | None = None, fanout: int = FANOUT) -> LevelledRuns:
    """The runs over all documents."""
    ids = docs.select(_doc(id_col).alias("doc"))
    n = ids.count()
    batches = batches or max(LEAST_BATCHES, -(-n // DOCS_PER_BATCH))
    buckets = max(LEAST_BUCKETS, -(-n // DOCS_PER_BUCKET))
    edges = (ids.approxQuantile("doc", [i / batches for i in range(1, batches)], min(0.01, 0.25 / batches))
             if batches > 1 else [])
    batch = F.lit(0)
    for edge in edges:
        batch = batch + (F.col("doc") < F.lit(int(edge))).cast("int")
    keys = _exploded(docs, id_col, text_col, min_chars)
    if not ids.groupBy("doc").count().where("count > 1").isEmpty():
        keys = keys.dropDuplicates(["doc", *KEY])
    counted = (keys.groupBy(batch.alias("batch"), *KEY).agg(F.count("*").alias("docs"), F.max("doc").alias("keeper"))
               .repartition(buckets, *KEY))
    counted = scratch.bucketed(counted, buckets, KEY, ["batch", *KEY])
    runs = LevelledRuns(scratch, buckets, min_docs, fanout)
    for i in range(len(edges) + 1):
        runs.add(counted.where(F.col("batch") == i).drop("batch"), last=i == len(edges))
    return runs


def _flags(keys: pa.Table):
    """A function of (id, h1 and h2 of each line) that tells which lines the document loses."""
    h1, h2, keeper = (keys.column(c).to_numpy() for c in (*KEY, "keeper"))
    order = np.lexsort((h2, h1))
    h1, h2, keeper = h1[order], h2[order], keeper[order]
    same = int(np.unique(h1, return_counts=True)[1].max())      # keys that share their first 64 bits

    @F.arrow_udf("array<boolean>")
    def lost(doc: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        offsets = first.offsets.to_numpy() - first.offsets[0].as_py()
        a, b = first.flatten(), second.flatten()
        known = np.flatnonzero(a.is_valid().to_numpy(zero_copy_only=False))
        x, y = a.drop_null().to_numpy(), b.drop_null().to_numpy()
        below = np.repeat(doc.to_numpy(), np.diff(offsets))[known]
        out = np.zeros(len(a), bool)
        at = np.searchsorted(h1, x)
        for step in range(same):
            here = np.minimum(at + step, len(h1) - 1)
            out[known] |= (h1[here] == x) & (h2[here] == y) & (below < keeper[here])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out))
    return lost


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
                min_docs: int = 3, batches: int | None = None, fanout: int = FANOUT,
                counts: bool = False, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` with the repeated lines taken out of the text; ``counts`` adds n_lines and n_dropped."""
    with Scratch(docs.sparkSession, "lines") as scratch:
        runs = settled_keys(docs, scratch, id_col, text_col, min_chars, min_docs, batches, fanout)
        settled = scratch.store(runs.settled(), "settled")
        n = settled.count()
        few = settled.toArrow() if n <= broadcast_keys else None
        settled = None if few is not None else store(settled, "line-keys")
    lines, key = _lines(F.col(text_col)), _keyed(F.col(text_col), min_chars)
    if n == 0:
        rows = docs.withColumn("_ld_lost", F.lit(None).cast("array<boolean>"))
    elif few is not None:
        h1, h2 = F.transform(key, lambda k: k["h1"]), F.transform(key, lambda k: k["h2"])
        rows = docs.withColumn("_ld_lost", _flags(few)(_doc(id_col), h1, h2))
    else:
        drop = (_exploded(docs, id_col, text_col, min_chars).join(settled, KEY).where(F.col("doc") < F.col("keeper"))
                .groupBy(F.col("doc").alias("_ld_doc")).agg(F.collect_set(F.struct(*KEY)).alias("_ld_drop")))
        rows = docs.withColumn("_ld_doc", _doc(id_col)).join(drop, "_ld_doc", "left").withColumn(
            "_ld_lost", F.when(F.col("_ld_drop").isNotNull(), F.transform(
                key, lambda k: k.isNotNull() & F.coalesce(F.array_contains("_ld_drop", k), F.lit(False)))))
    hit = F.coalesce(F.exists("_ld_lost", lambda x: x), F.lit(False))
    kept = F.filter(lines, lambda _, i: ~F.get(F.col("_ld_lost"), i))
    rows = rows.withColumn("_ld_kept", F.when(hit, kept))
    cut = F.col("_ld_kept").isNotNull()
    out = rows.withColumn("_ld_text", F.when(cut, F.array_join("_ld_kept", "\n")).otherwise(F.col(text_col)))
    extra = []
    if counts:
        size = F.size(lines).cast("long")
        extra = [size.alias("n_lines"), F.when(cut, size - F.size("_ld_kept")).otherwise(F.lit(0)).cast("long").alias("n_dropped")]
    columns = [F.col("_ld_text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns, *extra)
