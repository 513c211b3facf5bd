"""Benchmark decontamination, in DataFrame functions only.

The benchmark's normalised windows (``n`` consecutive words; a shorter item is
one window) become a hash set that goes out with the plan, once its size is
checked.  Each document is scanned in place: words outside the benchmark's
vocabulary end a run, windows are hashed only in texts with a run long enough to
hold one, and a hash that hits is verified on the words themselves.  A benchmark
beyond ``broadcast_limit`` windows takes a hash join on (hash, words) instead;
the results are the same.

Edge cases: a null or wordless text has no words and no hits; a wordless item
has no window and hits nothing; repeated items and rows each count once per id
and per row; a null item id counts as the id ''; a null document id is kept.
Extra columns pass through ``remove_contaminated``; columns that begin with
``_dc_`` are reserved.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_spark.llm.common import ascii_lower, store

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_LIMIT = 200_000


def word_array(text: Column) -> Column:
    """Lower-cased words: runs of 0-9, a-z and everything beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _windows(words: Column, length: int) -> Column:
    """(start from 0, hash, words) of each window; hash first, words on demand."""
    starts = F.when(F.size(words) >= length, F.sequence(F.lit(0), F.size(words) - length)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(
        i.alias("start"), F.xxhash64(F.slice(words, i + 1, length)).alias("hash")))


@dataclass
class Benchmark:
    """The windows of a benchmark: a table, and within the limit the literal sets of it."""
    table: DataFrame                     # hash, gram (words), item_ids
    small: bool
    by_length: dict[int, dict[str, list]] = field(default_factory=dict)   # length -> vocabulary, hashes


def benchmark_windows(benchmark: DataFrame, n: int = 10, item_col: str = "item_id", text_col: str = "text",
                      broadcast_limit: int = BROADCAST_LIMIT) -> Benchmark:
    """Normalised windows of the items, each with the ids of the items that hold it."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                             word_array(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(n))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    grams = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, length))).alias("gram"))
    table = store(grams.groupBy(F.xxhash64("gram").alias("hash"), "gram")
                  .agg(F.collect_set("item").alias("item_ids")), "benchmark-windows")
    small = table.limit(broadcast_limit + 1).count() <= broadcast_limit
    out = Benchmark(table, small)
    if small:
        for row in (table.groupBy(F.size("gram").alias("length"))
                    .agg(F.collect_set("hash").alias("hashes"),
                         F.array_distinct(F.flatten(F.collect_set("gram"))).alias("vocabulary")).collect()):
            out.by_length[row["length"]] = {"hashes": row["hashes"], "vocabulary": row["vocabulary"]}
    else:
        for row in table.select(F.size("gram").alias("length")).distinct().collect():
            out.by_length[row["length"]] = {}
    return out


def _hits(words: Column, bench: Benchmark) -> Column:
    """Array of (start, gram) of the windows whose hash is in the set (all windows beyond the limit)."""
    found = []
    for length, sets in sorted(bench.by_length.items()):
        windows = _windows(words, length)
        if bench.small:
            run = F.array_join(F.transform(words, lambda w: F.when(w.isin(sets["vocabulary"]), "1").otherwise("0")), "")
            windows = F.when(F.contains(run, F.lit("1" * length)),
                             F.filter(windows, lambda x: x["hash"].isin(sets["hashes"])))
        found.append(F.transform(windows, lambda x: F.struct(
            x["start"].alias("start"), x["hash"].alias("hash"),
            F.slice(words, x["start"] + 1, length).alias("gram"))))
    empty = F.array().cast("array<struct<start:int,hash:bigint,gram:array<string>>>")
    if not found:
        return empty
    return F.coalesce(F.flatten(F.array(*[F.coalesce(f, empty) for f in found])), empty)


def _found(docs: DataFrame, bench: Benchmark, id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    """One row per document row: _dc_row, _dc_id, n_words, spans, items; and the covered word positions as a column of it."""
    scanned = (docs.select(F.monotonically_increasing_id().alias("_dc_row"), F.col(id_col).alias("_dc_id"),
                           word_array(F.col(text_col)).alias("words"))
               .select("_dc_row", "_dc_id", F.size("words").cast("long").alias("n_words"),
                       _hits(F.col("words"), bench).alias("hits")))
    hits = scanned.select("_dc_row", "_dc_id", "n_words", F.explode_outer("hits").alias("hit")).select(
        "_dc_row", "_dc_id", "n_words", F.col("hit.start").alias("start"), F.col("hit.hash").alias("hash"),
        F.col("hit.gram").alias("gram"))
    table = F.broadcast(bench.table) if bench.small else bench.table
    joined = hits.join(table, ["hash", "gram"], "left")
    real = F.when(F.col("item_ids").isNotNull(), F.struct("start", F.size("gram").alias("length")))
    grouped = joined.groupBy("_dc_row", "_dc_id", "n_words").agg(
        F.collect_set(real).alias("spans"), F.collect_set("item_ids").alias("items"))
    covered = F.array_distinct(F.flatten(F.transform(
        "spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    return grouped, covered


def find_hits(docs: DataFrame, bench: Benchmark, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, n_words, n_hit (words inside a window), item_ids (sorted strings), contaminated."""
    grouped, covered = _found(docs, bench, id_col, text_col)
    return grouped.select(
        F.col("_dc_row"), F.col("_dc_id").alias(id_col), "n_words",
        F.size(covered).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten("items"))).alias("item_ids"),
        (F.size("spans") > 0).alias("contaminated"))


def _verified(words: Column, bench: Benchmark) -> Column:
    """Within the limit: the hits whose words are a window of the benchmark, checked in place."""
    known = [" ".join(row["gram"]) for row in bench.table.select("gram").collect()]
    return F.filter(_hits(words, bench), lambda hit: F.array_join(hit["gram"], " ").isin(known))


def remove_contaminated(docs: DataFrame, bench: Benchmark, mode: str = "documents",
                        text_col: str = "text") -> DataFrame:
    """The documents without contamination: hit documents go, or (``mode="spans"``) lose the hit words.

    Within the limit this is one scan without a shuffle.  A removed word takes the
    separators before it along; the columns stay those of ``docs``.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode!r}")
    if not bench.small:
        rows = docs.withColumn("_dc_row", F.monotonically_increasing_id())
        marked = store(rows, "decontaminate-rows")
        grouped, covered = _found(marked, bench, "_dc_row", text_col)
        hit = grouped.where(F.size("spans") > 0).select(F.col("_dc_id").alias("_dc_row"), covered.alias("_dc_positions"))
        if mode == "spans":
            return _without(marked.join(hit, "_dc_row", "left").drop("_dc_row"), text_col)
        return marked.join(hit, "_dc_row", "left_anti").drop("_dc_row")
    # the row number keeps the split words a column: a filter below it would split anew for every window
    scanned = docs.select("*", F.monotonically_increasing_id().alias("_dc_row"), word_array(F.col(text_col)).alias("_dc_words"))
    hits = _verified(F.col("_dc_words"), bench)
    if mode == "documents":
        return scanned.where((F.size(hits) == 0) & (F.col("_dc_row") >= 0)).drop("_dc_row", "_dc_words")
    positions = F.array_distinct(F.flatten(F.transform(
        hits, lambda h: F.sequence(h["start"], h["start"] + F.size(h["gram"]) - 1))))
    return _without(scanned.withColumn("_dc_positions", positions).drop("_dc_row", "_dc_words"), text_col)


def _without(docs: DataFrame, text_col: str) -> DataFrame:
    """The texts without the words at ``_dc_positions``."""
    ink = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    pieces = F.regexp_extract_all(text_col, F.lit(f"({gap}{ink})"), F.lit(1))
    kept = F.filter(pieces, lambda _, i: ~F.array_contains("_dc_positions", i))
    tail = F.regexp_extract(text_col, f"({gap})$", 1)
    cleaned = F.concat(F.array_join(kept, ""), tail)
    return docs.withColumn(text_col, F.when(F.size("_dc_positions") > 0, cleaned).otherwise(F.col(text_col))).drop(
        "_dc_positions")
