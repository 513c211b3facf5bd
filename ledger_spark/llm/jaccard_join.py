"""N-gram Jaccard join with adaptive multi-match prefixes.

A text's set is its distinct shingles of k words (64-bit hashes); equal sets are one
class.  Shingles are ordered by how often they are known to occur, then by hash.  A
set of n shingles, of which a partner must share m = ceil(percent n / 100), has an
l-prefix of n - m + l shingles, and two linked sets share at least
min(l, l') shingles of their prefixes.  Each class picks its own l: a longer prefix
scans longer posting lists but fewer partners reach the count; the expected cost of
both decides.

Candidates come in two steps.  First each shingle's posting list links its members
to one of them, the one that holds it earliest in its order (few rare shingles of its
own: near the original, if the members are copies); verified links give first groups.  Then all members of a
list that are still in different groups are paired, members of the list's largest
group only with those outside it, under size and position bounds.  Only pairs that
share enough prefix shingles and can still reach the overlap (by position, and by a
histogram of each set) are verified, on the whole sets.  So a group of thousands of near copies is no square of pairs, and no
link between different groups is missed.

How often shingles occur is counted over all documents: a task's slice reports those
that it sees twice; a shingle in d documents over s slices is seen so with
probability 1 - exp(-d d / 2 s).  The ``FREQUENT`` most frequent go out to all tasks;
they order the prefixes and never change the result.

Edge cases: null or wordless texts have empty sets, link with nothing and form their
own component; fewer than k words are one shingle; rows that repeat an id are rows of
their own and their component is named by its smallest id; null ids come last among a
component's ids; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledger_spark.llm import words as W
from ledger_spark.llm.common import Scratch, store
from ledger_spark.llm.components import components

FREQUENT = 1 << 18          # shingles in the broadcast order
SLICE_SHINGLES = 1 << 21    # shingles counted together in a task
MOST_MATCHES = 4
PAIR_COST, VERIFY_COST = 1.0, 100.0
CELLS = 64                  # of the histogram that bounds a pair's overlap before verification
FILTER_BITS = 24            # of the bitmap that picks the texts to verify


def _sets(part: W.Slice, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of the slice."""
    hashes = part.hashes(True)
    grams = W.grams(hashes, k)
    out = []
    for lo, hi in zip(part.bounds[:-1].tolist(), part.bounds[1:].tolist()):
        if hi - lo >= k:
            out.append(np.unique(grams[lo:hi - k + 1]))
        elif hi > lo:
            out.append(W.grams(hashes[lo:hi], hi - lo) ^ np.uint64(hi - lo))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signature(shingles: np.ndarray) -> int:
    """One 64-bit number for a set."""
    total = W.mix(shingles + np.uint64(0x51)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(W.mix(np.array([total], np.uint64)).view(np.int64)[0])


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, cls) of every row; cls is null for an empty set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch.column("text")):
                sets = _sets(part, k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(part.lo, part.hi - part.lo), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([_signature(s) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "n", "cls"])
    return docs.mapInArrow(run, "doc_id long, n long, cls long")


def _frequent(docs: DataFrame, k: int, most: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` frequent shingles, sorted, and the documents counted for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(pending):
            values, counts = np.unique(np.concatenate(pending), return_counts=True)
            again = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(values[again].view(np.int64)), pa.array(counts[again].astype(np.int64))],
                                              names=["shingle", "seen"])
        pending, held = [], 0
        for batch in batches:
            for part in W.slices(batch.column("text")):
                sets = _sets(part, k)
                pending += sets
                held += sum(map(len, sets))
                if held >= SLICE_SHINGLES:
                    yield flush(pending)
                    pending, held = [], 0
        if pending:
            yield flush(pending)
    seen = docs.mapInArrow(run, "shingle long, seen long").groupBy("shingle").agg(F.sum("seen").alias("seen"))
    level = F.floor(F.log2("seen") * 8).cast("int")
    seen = scratch.store(seen.withColumn("level", level), "shingle-counts")
    total, least = 0, 1 << 30
    for row in seen.groupBy("level").count().orderBy(F.desc("level")).collect():
        total += row["count"]
        if total > most:
            break
        least = row["level"]
    found = seen.where(F.col("level") >= least).select("shingle", "seen").toArrow()
    shingles = found.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], found.column("seen").to_numpy()[order]


def _required(n: int, percent: int) -> int:
    """The least overlap of a set of n shingles with a linked set."""
    return -(-percent * n // 100)


def matches(seen: np.ndarray, n: int, percent: int, most: int = MOST_MATCHES) -> int:
    """The number of shared prefix shingles to ask for; ``seen``: how often the set's shingles occur, in order."""
    need = _required(n, percent)
    best, choice, scanned = None, 1, float(seen[:n - need].sum())
    for asked in range(1, min(most, need) + 1):
        scanned += float(seen[n - need + asked - 1])
        cost = PAIR_COST * scanned + VERIFY_COST * scanned / asked ** 2
        if best is None or cost < best:
            best, choice = cost, asked
    return choice


def _prefixes(docs: DataFrame, k: int, percent: int, shingles: np.ndarray, seen: np.ndarray) -> DataFrame:
    """(doc_id, cls, n, asked, prefix, cells) of every non-empty row; the prefix in global order, the set's size by cell."""
    common = np.zeros(1 << 20, bool)
    common[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def counts(s: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s), np.int64)
        maybe = np.flatnonzero(common[(s & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(shingles, s[maybe]), len(shingles) - 1)
            same = shingles[at] == s[maybe]
            out[maybe[same]] = seen[at[same]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch.column("text")):
                ids = batch.column("doc_id").slice(part.lo, part.hi - part.lo).to_pylist()
                out: dict[str, list] = {c: [] for c in ("doc_id", "cls", "n", "asked", "prefix", "cells")}
                for doc_id, s in zip(ids, _sets(part, k)):
                    n = len(s)
                    if n:
                        c = counts(s)
                        order = np.argsort(c, kind="stable")
                        asked = matches(c[order], n, percent)
                        out["doc_id"].append(doc_id)
                        out["cls"].append(_signature(s))
                        out["n"].append(n)
                        out["asked"].append(asked)
                        out["prefix"].append(s[order[:n - _required(n, percent) + asked]].view(np.int64))
                        out["cells"].append(np.bincount((s & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["doc_id"], pa.int64()), pa.array(out["cls"], pa.int64()), pa.array(out["n"], pa.int64()),
                     pa.array(out["asked"], pa.int32()), pa.array(out["prefix"], pa.list_(pa.int64())),
                     pa.array(out["cells"], pa.list_(pa.int32()))], names=list(out))
    return docs.mapInArrow(run, "doc_id long, cls long, n long, asked int, prefix array<bigint>, cells array<int>")


def _can_link(overlap: Column, n1: Column, n2: Column, percent: int) -> Column:
    return overlap * (100 + percent) >= (n1 + n2) * percent


def _possible(x: str, y: str, percent: int, before: str = "pos") -> Column:
    """Size and position bounds of two postings of one shingle; ``before``: how many earlier shingles they can share."""
    n1, n2, p1, p2 = (F.col(c) for c in (f"{x}.n", f"{y}.n", f"{x}.pos", f"{y}.pos"))
    return ((F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent)
            & _can_link(F.least(f"{x}.{before}", f"{y}.{before}") + 1 + F.least(n1 - p1 - 1, n2 - p2 - 1), n1, n2, percent))


def _promising(pairs: DataFrame, percent: int, every_match: bool) -> DataFrame:
    """(a, b) that share enough prefix shingles and can still reach the overlap, of rows (x, y) of postings.

    With ``every_match`` the rows hold all shingles that two prefixes share.  Of the
    prefix that ends first in the global order nothing shared is then unseen but what
    lies behind it, so the pair must share the rest of the overlap within the prefixes.
    """
    grouped = pairs.groupBy(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).agg(
        F.count("*").alias("shared"), F.max("x.n").alias("n1"), F.max("y.n").alias("n2"),
        F.max("x.asked").alias("asked1"), F.max("y.asked").alias("asked2"),
        F.max("x.pos").alias("p1"), F.max("y.pos").alias("p2"))
    n1, n2, shared = F.col("n1"), F.col("n2"), F.col("shared")
    behind = F.least(n1 - F.col("p1") - 1, n2 - F.col("p2") - 1)
    good = (shared >= F.least("asked1", "asked2")) & _can_link(shared + behind, n1, n2, percent)
    if every_match:
        unseen = lambda n, asked: F.ceil(n * percent / 100.0 - 1e-9) - F.col(asked)
        good = good & _can_link(shared + F.greatest(unseen(n1, "asked1"), unseen(n2, "asked2")), n1, n2, percent)
    return grouped.where(good).select("a", "b")


def _fetch(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cls, shingles) of the wanted (cls, rep): a bitmap of fixed size picks rows in the scan, a join the right ones."""
    slot = F.pmod(F.xxhash64("rep"), F.lit(1 << FILTER_BITS))
    cells = (wanted.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 32).cast("int").alias("cell"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("bits")).toArrow())
    bitmap = np.zeros(1 << (FILTER_BITS - 5), np.int64)
    bitmap[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    picked = docs.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("slot").to_numpy(zero_copy_only=False).astype(np.int64)
            some = pa.array(np.flatnonzero((bitmap[at >> 5] >> (at & 31)) & 1))
            ids = batch.column("doc_id").take(some)
            for part in W.slices(batch.column("text").take(some)):
                sets = _sets(part, k)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(part.lo, part.hi - part.lo), pa.array([_signature(s) if len(s) else None for s in sets], pa.int64()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "cls", "shingles"])
    sets = picked.mapInArrow(run, "doc_id long, cls long, shingles binary")
    return (sets.join(wanted, (sets["cls"] == wanted["cls"]) & sets["doc_id"].eqNullSafe(wanted["rep"]))
            .select(sets["cls"], "shingles").dropDuplicates(["cls"]))


def _verify(docs: DataFrame, classes: DataFrame, cells: DataFrame, pairs: DataFrame, k: int, percent: int,
            outer: Scratch) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity.

    No cell of the hash space holds more shared shingles than the smaller of the two
    counts there, so their sum bounds the overlap; pairs within it are verified on the sets.
    """
    bound = F.aggregate(F.zip_with("s", "t", lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)
    size = lambda c: F.aggregate(c, F.lit(0), lambda total, x: total + x)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("s"), batch.column("t")):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
                good.append(100 * shared >= percent * (len(s) + len(t) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
    with Scratch(docs.sparkSession, "verify") as scratch:
        pairs = scratch.store(pairs.join(cells.select(F.col("cls").alias("a"), F.col("cells").alias("s")), "a")
                      .join(cells.select(F.col("cls").alias("b"), F.col("cells").alias("t")), "b")
                      .where(_can_link(bound, size("s"), size("t"), percent)).select("a", "b"), "candidate-pairs")
        ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
        sets = scratch.store(_fetch(docs, classes.select("cls", "rep").join(ends, "cls"), k), "candidate-sets")
        both = (pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("s")), "a")
                .join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("t")), "b"))
        return outer.store(both.select("a", "b", "s", "t").mapInArrow(run, "a long, b long"), "links")


def _labels(docs: DataFrame, signed: DataFrame, k: int, percent: int, frequent: int, scratch: Scratch) -> DataFrame:
    """(cls, component_id) of every class."""
    classes = scratch.store(signed.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep")), "classes")
    prefixes = _prefixes(docs, k, percent, *_frequent(docs, k, frequent, scratch))
    own = (prefixes.join(classes.withColumnRenamed("cls", "c"), (F.col("cls") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("rep")))
           .select("cls", "n", "asked", "prefix", "cells").dropDuplicates(["cls"]))
    own = scratch.store(own, "prefixes")
    postings = own.select("cls", "n", "asked", F.posexplode("prefix").alias("pos", "shingle"))
    member = F.struct("pos", "cls", "n", "asked")    # the least: the one with the fewest rare shingles before
    lists = postings.groupBy("shingle").agg(F.count("*").alias("size"), F.min(member).alias("x")).where("size > 1")
    shared = scratch.store(postings.join(lists.drop("size"), "shingle").select("shingle", member.alias("y"), "x"), "postings")

    near = shared.where("x.cls != y.cls").where(_possible("x", "y", percent))
    links = _verify(docs, classes, own, _promising(near, percent, False), k, percent, scratch)

    groups = components(links, rounds=3, store=scratch.store)
    placed = (shared.select("shingle", F.col("y"), F.col("y.cls").alias("node")).join(groups, "node", "left")
              .select("shingle", "y", F.coalesce("root", "node").alias("grp")))
    sizes = placed.groupBy("shingle", "grp").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("shingle").agg(F.count("*").alias("groups"), F.max_by("grp", F.struct("c", "grp")).alias("main"))
    # what two texts of different groups share before a shingle lies in open lists as well
    rank = F.row_number().over(Window.partitionBy("y.cls").orderBy("y.pos")) - 1
    open_lists = scratch.store(placed.join(mixed.where("groups > 1").drop("groups"), "shingle")
                       .withColumn("y", F.col("y").withField("before", rank)), "open-postings")
    left = open_lists.where("grp != main").select("shingle", F.col("y").alias("x"), F.col("grp").alias("g"))
    right = open_lists.select("shingle", "y", F.col("grp").alias("h"), "main")
    cross = (left.join(right, "shingle").where("g != h")
             .where((F.col("h") == F.col("main")) | (F.col("x.cls") < F.col("y.cls")))
             .where(_possible("x", "y", percent, "before")))
    swap = F.col("x.cls") > F.col("y.cls")
    cross = cross.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("x"),
                         F.when(swap, F.col("x")).otherwise(F.col("y")).alias("y"))
    more = _verify(docs, classes, own, _promising(cross, percent, True), k, percent, scratch)

    roots = components(links.unionByName(more), store=scratch.store)
    named = (classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left")
             .select("cls", "rep", F.coalesce("root", "cls").alias("root")))
    names = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return named.join(names, "root").select("cls", "component_id")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                    frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_shingles, cls, component_id) for each row: texts link at a Jaccard similarity of ``percent`` / 100.

    ``cls`` numbers the equal sets (null: empty); ``component_id`` is the smallest id
    that links reach, the row's own id for an empty set.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = store(_signatures(docs, k), "signatures")
    with Scratch(docs.sparkSession, "jaccard") as scratch:
        labels = store(_labels(docs, signed, k, percent, frequent, scratch), "components")
    return (signed.join(labels, "cls", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), "cls",
                    F.coalesce("component_id", "doc_id").alias("component_id")))
