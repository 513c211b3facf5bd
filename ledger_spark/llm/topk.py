"""Exact top-k inner-product search by a three-phase uniform threshold.

Vectors become integers; equal vectors are one class, which keeps its k + 1
smallest ids (no more can appear in a result).  Query classes and candidate
classes are packed into tiles of bounded size, and every (query tile, candidate
tile) pair is one unit of work.  A unit's nodes are blocks of dimensions, whose
scores add up to the inner product:

1. each node lists its k + 1 best partial scores per query; the totals of the
   listed entries are gathered and the (k + 1)-th best is a safe cutoff;
2. the cutoff goes back to all units; an entry that can reach it must reach
   cutoff / nodes in some node, so each node names only those;
3. the named entries' totals are resolved exactly and those at the cutoff or above
   are ranked, ties to the smaller id.

Edge cases: vectors that are null or hold null or non-finite components take no
part, nor do rows without an id; shorter vectors count as padded with zeros; rows
that repeat id and vector count once, and a query's own id is never its result;
fewer than k candidates give all of them; an empty table gives no rows; extra
columns are ignored.  Inner products must fit 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledger_spark.llm.common import store

QUERY_TILE = 1024
CANDIDATE_TILE = 4096
NODES = 2
SALT_ROWS = 100_000


def _codes(vectors: DataFrame, id_col: str, vector_col: str, scale: int, dims: int) -> DataFrame:
    """(vec_id, code): the integer components of each usable vector, packed as int64."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, codes = [], []
            for vec_id, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if vec_id is None or row is None or any(x is None for x in row):
                    continue
                x = np.array(row, np.float64)
                if np.isfinite(x).all():
                    code = np.zeros(dims, np.int64)
                    code[:len(x)] = np.floor(scale * x)
                    ids.append(vec_id)
                    codes.append(code.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codes, pa.binary())], names=["vec_id", "code"])
    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(run, "vec_id long, code binary")


def _number(bound: int) -> type:
    """The quickest type in which sums up to ``bound`` are exact."""
    if bound >= 1 << 63:
        raise ValueError("inner products do not fit 63 bits")
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


def _unpack(column: pa.Array, i: int, dims: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column[i].as_py()), np.int64).reshape(-1, dims).astype(kind)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, in any order."""
    return np.argpartition(scores, scores.shape[1] - k, axis=1)[:, -k:] if scores.shape[1] > k else np.broadcast_to(
        np.arange(scores.shape[1]), scores.shape)


def top_k(vectors: DataFrame, k: int = 20, query_every: int = 20, scale: int = 64, id_col: str = "vec_id",
          vector_col: str = "embedding", nodes: int = NODES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each id divisible by ``query_every``."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    shape = vectors.agg(F.max(F.size(vector_col)).alias("dims"), F.count("*").alias("n")).first()
    dims = max(shape["dims"] or 0, 1)
    codes = store(_codes(vectors, id_col, vector_col, scale, dims), "codes")
    salts = shape["n"] // SALT_ROWS + 1
    keep = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    classes = (codes.groupBy("code", F.pmod(F.hash("vec_id"), F.lit(salts)).alias("salt"))
               .agg(keep(F.collect_set("vec_id")).alias("ids"))
               .groupBy("code").agg(keep(F.flatten(F.collect_list("ids"))).alias("ids")))
    classes = store(classes, "vector-classes")
    queries = codes.where(F.col("vec_id") % query_every == 0)
    asked = queries.select("code").distinct()
    n_candidates, n_queries = classes.count(), asked.count()
    if not n_queries:
        return spark.createDataFrame([], schema)
    c_tiles, q_tiles = -(-n_candidates // CANDIDATE_TILE), -(-n_queries // QUERY_TILE)
    candidate_tiles = store(classes.groupBy(F.pmod(F.xxhash64("code"), F.lit(c_tiles)).alias("ct"))
                            .agg(F.collect_list(F.struct("code", "ids")).alias("m"))
                            .select("ct", F.col("m.code").alias("codes"), F.col("m.ids").alias("ids")), "candidate-tiles")
    query_tiles = store(asked.groupBy(F.pmod(F.xxhash64("code"), F.lit(q_tiles)).alias("qt"))
                        .agg(F.collect_list("code").alias("queries")), "query-tiles")
    peak = _peak(codes)
    kind = _number(max(dims * peak * peak, 1))
    blocks = [b for b in np.array_split(np.arange(dims), nodes) if len(b)]
    share = float(len(blocks))
    list_size = k + 1

    units = candidate_tiles.withColumn("qt", F.explode(F.sequence(F.lit(0), F.lit(q_tiles - 1)).cast("array<bigint>")))

    def local_lists(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q, c = _unpack(batch.column("queries"), i, dims, kind), _unpack(batch.column("codes"), i, dims, kind)
                parts = [q[:, b] @ c[:, b].T for b in blocks]
                total = np.sum(parts, axis=0) if len(parts) > 1 else parts[0]
                listed = np.zeros(total.shape, bool)
                for part in parts:
                    np.put_along_axis(listed, _best(part, list_size), True, axis=1)
                best = [np.sort(total[row, listed[row]])[::-1][:list_size].astype(np.int64).tolist() for row in range(len(q))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(q), batch.column("qt")[i].as_py()), pa.int64()),
                     pa.array(np.arange(len(q)), pa.int32()), pa.array(best, pa.list_(pa.int64()))],
                    names=["qt", "qi", "best"])

    def resolve(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q, c = _unpack(batch.column("queries"), i, dims, kind), _unpack(batch.column("codes"), i, dims, kind)
                ids = batch.column("ids")[i].as_py()
                least = np.array([x[0] for x in ids], np.int64)
                cutoff = np.full(len(q), -np.inf)
                for entry in batch.column("cutoffs")[i].as_py():
                    cutoff[entry["qi"]] = -np.inf if entry["cutoff"] is None else entry["cutoff"]
                threshold = (cutoff / share)[:, None]
                named = np.zeros((len(q), len(c)), bool)
                for b in blocks:
                    named |= q[:, b] @ c[:, b].T >= threshold
                rows, cols = np.nonzero(named)
                out = {"qi": [], "score": [], "ids": []}
                for lo in range(0, len(rows), 1 << 16):
                    r, s = rows[lo:lo + (1 << 16)], cols[lo:lo + (1 << 16)]
                    exact = np.einsum("ij,ij->i", q[r].astype(np.int64), c[s].astype(np.int64))
                    reach = exact >= cutoff[r]
                    out["qi"].append(r[reach])
                    out["score"].append(exact[reach])
                    out["ids"].append(s[reach])
                qi, score, at = (np.concatenate(out[x]) if out[x] else np.zeros(0, np.int64) for x in ("qi", "score", "ids"))
                order = np.lexsort((least[at], -score, qi))
                qi, score, at = qi[order], score[order], at[order]
                place = np.arange(len(qi)) - np.searchsorted(qi, qi)
                best = place < list_size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(int(best.sum()), batch.column("qt")[i].as_py()), pa.int64()),
                     pa.array(qi[best].astype(np.int32)), pa.array(score[best].astype(np.int64)),
                     pa.array([ids[j] for j in at[best]], pa.list_(pa.int64()))], names=["qt", "qi", "score", "ids"])

    lists = units.join(query_tiles, "qt").select("qt", "queries", "codes").repartition(q_tiles * c_tiles).mapInArrow(
        local_lists, "qt long, qi int, best array<bigint>")
    gathered = lists.groupBy("qt", "qi").agg(F.sort_array(F.flatten(F.collect_list("best")), asc=False).alias("best"))
    cutoffs = (gathered.select("qt", F.struct("qi", F.get("best", F.lit(list_size - 1)).alias("cutoff")).alias("entry"))
               .groupBy("qt").agg(F.collect_list("entry").alias("cutoffs")))
    told = query_tiles.join(cutoffs, "qt")
    found = units.join(told, "qt").select("qt", "queries", "codes", "ids", "cutoffs").repartition(q_tiles * c_tiles).mapInArrow(
        resolve, "qt long, qi int, score long, ids array<bigint>")
    by_class = Window.partitionBy("qt", "qi").orderBy(F.col("score").desc(), "vec_id")
    answers = (found.select("qt", "qi", "score", F.explode("ids").alias("vec_id"))
               .withColumn("place", F.row_number().over(by_class)).where(F.col("place") <= k + 1).drop("place"))
    named = query_tiles.select("qt", F.posexplode("queries").alias("qi", "code"))
    rows = (queries.distinct().join(named, "code").select(F.col("vec_id").alias("query_id"), "qt", "qi")
            .join(answers, ["qt", "qi"]).where(F.col("query_id") != F.col("vec_id")))
    by_query = Window.partitionBy("query_id", "qt", "qi").orderBy(F.col("score").desc(), "vec_id")
    return (rows.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _peak(codes: DataFrame) -> int:
    """The largest absolute component."""
    def run(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([int(max(x.max(), -x.min()))], pa.int64())], names=["peak"])
    return codes.select("code").mapInArrow(run, "peak long").agg(F.max("peak")).first()[0] or 0
