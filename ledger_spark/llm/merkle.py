"""A Merkle manifest of a data set: one tree per key, and one tree over the keys' roots.

Only every third level is stored (``STRIDE``): the leaves, the nodes 3 levels up, 6
levels up, and so on.  A stored node and the 512 stored descendants below it are an
aligned subtree, rebuilt by one task whenever it is needed: once to make the node,
and once for the proofs, when the missing levels are made again from the stored
descendants, their siblings emitted, and the nodes thrown away.

The tree: a run is up to 8 consecutive nodes (the last one may hold fewer, even
one); a run's parent is the hash of its members.  Levels are added until one node
remains, so a lone leaf is its tree's root.  Digests are lower-case hex, hashed as text.

Edge cases: a null field is hashed as ``-``, an empty one as ``0:``; a null key is a key
of its own and comes first; rows that tie in the order column are ordered by leaf, and
equal rows are interchangeable; a null in the order column comes first; an empty table
has no rows and no root.  Extra columns pass through ``prove`` if they are named in ``keep``
(names of ``RESERVED`` are refused).
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ledger_spark.llm.common import store
from ledger_spark.llm.order import numbered

FANOUT = 8
STRIDE = 3
SPAN = FANOUT ** STRIDE

#: The tree over the keys' roots is kept under this number; the keys count from 0.
_TOP = -1


def digest(*parts: Column) -> Column:
    """SHA-256 of the texts one after the other, as lower-case hex."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """A row's hash: of each field, ``-`` if null, else its length in UTF-8 bytes, a colon, and its text."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
                    for t in texts])


def _rounds(n: int) -> int:
    """Levels from one stored tier to the next, in a tree that has ``n`` nodes at the lower one."""
    rounds = 0
    while n > 1 and rounds < STRIDE:
        n, rounds = -(-n // FANOUT), rounds + 1
    return rounds


def _levels(nodes: list[str], rounds: int) -> list[list[str]]:
    """The nodes of one aligned subtree, level by level from the stored ones up."""
    levels = [nodes]
    for _ in range(rounds):
        below = levels[-1]
        levels.append([hashlib.sha256("".join(below[i:i + FANOUT]).encode()).hexdigest() for i in range(0, len(below), FANOUT)])
    return levels


def _up(tier: DataFrame, name: str) -> DataFrame:
    """The next stored tier: one node per aligned subtree of the trees that have more than one node left."""

    def climb(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table.column("n")[0].as_py()
        rounds = _rounds(n)
        left = n
        for _ in range(rounds):
            left = -(-left // FANOUT)
        top = _levels(table.column("hash").to_pylist(), rounds)[-1]
        return pa.table({"tree": table.column("tree").slice(0, 1), "pos": pa.array([table.column("pos")[0].as_py() // SPAN], pa.int64()),
                         "hash": pa.array(top, pa.string()), "n": pa.array([left], pa.int64())})

    return store(tier.where("n > 1").select("tree", "pos", "hash", "n").groupBy("tree", F.expr(f"pos div {SPAN}").alias("part"))
                 .applyInArrow(climb, "tree long, pos long, hash string, n long"), name)


def _tiers(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The stored tiers of trees, from the given nodes up to the single roots; columns tree, pos, hash, n."""
    tiers = [nodes]
    while not tiers[-1].where("n > 1").isEmpty():
        tiers.append(_up(tiers[-1], f"{name}-{STRIDE * len(tiers)}"))
    return tiers


def _roots(tiers: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [tier.where("n = 1").select("tree", "hash") for tier in tiers])


def _paths(tiers: list[DataFrame], above: DataFrame, keep: list[str], carry: list[str]) -> DataFrame:
    """For every node of the lowest tier: tree, pos, its columns ``keep``, the siblings on the way up, and ``carry`` of its tree.

    ``above`` has, for every tree, what comes after its root: left, right and the columns of ``carry``.  One pair
    (left, right) per level: the run's members before the node and those after it.  Goes down tier by tier; each
    aligned subtree's inner nodes are made again from its stored ones and dropped when their siblings are out.
    Nothing is joined to the finished proofs: the nodes' own columns go through the same tasks.
    """

    def descend_with(own: list[str], schema: pa.Schema):
        def descend(table: pa.Table, above: pa.Table) -> pa.Table:
            if not table.num_rows:
                return schema.empty_table()
            table = table.sort_by("pos")
            nodes, n = table.column("hash").to_pylist(), table.column("n")[0].as_py()
            levels = _levels(nodes, _rounds(n))[:-1]
            rest_left, rest_right = above.column("left")[0].as_py(), above.column("right")[0].as_py()
            pairs = []
            for level in levels:
                runs = [level[i:i + FANOUT] for i in range(0, len(level), FANOUT)]
                pairs.append([("".join(run[:i]), "".join(run[i + 1:])) for run in runs for i in range(len(run))])
            left, right = [], []
            for i in range(len(nodes)):
                steps = [pairs[depth][i // FANOUT ** depth] for depth in range(len(levels))]
                left.append([a for a, _ in steps] + rest_left)
                right.append([b for _, b in steps] + rest_right)
            made = {"left": left, "right": right} | {c: [above.column(c)[0].as_py()] * len(nodes) for c in carry}
            return pa.table([pa.array(made[f.name], f.type) if f.name in made else table.column(f.name) for f in schema], schema=schema)
        return descend

    done = None
    for i, tier in reversed(list(enumerate(tiers))):
        own = ["tree", "pos", *(keep if i == 0 else [])]
        over = above.select(F.col("tree").alias("_mk_tree"), "left", "right", *carry)
        found = tier.where("n = 1").join(over, F.col("tree") == F.col("_mk_tree"))
        found = found.select(*own, "left", "right", *carry)
        if done is not None:
            part = F.expr(f"pos div {SPAN}")
            inner = (tier.where("n > 1").withColumn("part", part).groupBy("tree", "part")
                     .cogroup(done.select("tree", F.col("pos").alias("part"), "left", "right", *carry).groupBy("tree", "part"))
                     .applyInArrow(descend_with(own, to_arrow_schema(found.schema)), found.schema))
            found = found.unionByName(inner)
        done = found
    return done


#: Names that ``build`` and ``prove`` give; the columns passed to ``build`` must have others.
RESERVED = ("tree", "pos", "n", "hash", "part", "left", "right", "subroot", "root")


class Manifest:
    """The stored tiers of a data set's trees (the lowest with the rows' own columns) and the tiers over their roots."""

    def __init__(self, columns: list[str], keys: DataFrame, tiers: list[DataFrame], top_tiers: list[DataFrame]):
        self.columns, self.keys, self.tiers, self.top_tiers = columns, keys, tiers, top_tiers

    @property
    def root(self) -> DataFrame:
        """One row (root), or none for an empty data set."""
        return _roots(self.top_tiers).select(F.col("hash").alias("root"))

    @property
    def subroots(self) -> DataFrame:
        """The key's column, tree (its number) and subroot."""
        return self.keys.join(_roots(self.tiers).withColumnRenamed("hash", "subroot"), "tree")


def build(rows: DataFrame, key: str, order: str, keep: list[str] = ()) -> Manifest:
    """The manifest of ``rows`` that carry their ``leaf`` hash: a tree per ``key``, its leaves in the order of ``order``.

    Texts are not needed here: rows are dealt and stored with their key, order, leaf and the columns of ``keep``.
    """
    columns = list(dict.fromkeys([key, order, "leaf", *keep]))
    if clash := sorted(set(columns) & set(RESERVED)):
        raise ValueError(f"columns {clash} have names that the manifest gives")
    thin = store(rows.select(*columns), "merkle-rows")
    placed, sizes = numbered(thin, [key], [F.col(order).asc_nulls_first(), F.col("leaf")], "merkle-sorted", "pos")
    named = store(numbered(sizes, [], [F.col(key).asc_nulls_first()], "merkle-keys", "tree")[0], "merkle-trees")
    leaves = store(placed.join(named.withColumnRenamed(key, "_mk_named"), F.col(key).eqNullSafe(F.col("_mk_named")))
                   .select("tree", "pos", F.col("leaf").alias("hash"), "n", *columns), "merkle-leaves")
    tiers = _tiers(leaves, "merkle-tier")
    top = _roots(tiers).select(F.lit(_TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), "hash",
                               F.lit(named.count()).cast("long").alias("n"))
    top_tiers = _tiers(store(top, "merkle-subroots"), "merkle-top")
    return Manifest(columns, named.select(key, "tree"), tiers, top_tiers)


def prove(manifest: Manifest) -> DataFrame:
    """The manifest's rows with their proof: subroot, root, and one text per level, from leaf to root, in left and right."""
    none = F.array().cast("array<string>")
    over = manifest.root.select(F.lit(_TOP).cast("long").alias("tree"), none.alias("left"), none.alias("right"), "root")
    tops = _paths(manifest.top_tiers, over, ["hash"], ["root"]).select(
        F.col("pos").alias("tree"), "left", "right", F.col("hash").alias("subroot"), "root")
    return _paths(manifest.tiers, store(tops, "merkle-tops"), manifest.columns, ["subroot", "root"]).drop("tree", "pos")


def proof_digest(left: Column, right: Column) -> Column:
    """The hash of all siblings, level by level, left to right."""
    return digest(F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), ""))


def fold(leaf_hash: Column, left: Column, right: Column) -> Column:
    """The root that a leaf and the siblings of a proof lead to."""
    return F.aggregate(F.arrays_zip(left.alias("before"), right.alias("after")), leaf_hash,
                       lambda h, step: digest(step["before"], h, step["after"]))
