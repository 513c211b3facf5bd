"""Conversation repair: the cheapest edits that make a conversation's roles alternate properly.

The edits of one conversation are a path through a lattice: node (i, state) is "the
first i rows are dealt with, and the turns kept so far end in this state"; an arc keeps,
re-roles or deletes the next row or inserts a turn, at an integer cost.  Shortest paths
come from the auction algorithm: every node has a price, a path starts at the origin,
grows along the cheapest arc while its last node's price allows it, and otherwise that
price is raised and the path contracts by a node.  When the path reaches the end, arcs
whose cost equals the difference of prices are tight; every cheapest path consists of
tight arcs, and the one with the least letters is traced among those that lead to the end.

Long conversations are cut into blocks of 32 rows (``BLOCK``), each solved in a task of
its own: first the cheapest costs between its four entry and four exit states, then, once
the blocks behind it have told what each exit costs, one trace per entry state.  Between
the two, a streamed pass over the blocks of a conversation (sixteen numbers each, one
held at a time) chains them; it is the only work that one task does per conversation.

Edge cases: a null role or text is one space; a null conversation id is one conversation;
rows go by turn (null first), then role, then text; an empty role is like any unknown one
and cannot be kept; repeated rows are duplicates; an empty table gives no rows; extra
columns are ignored; a very long text is one value and is never split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_spark.llm.common import BLANKS, store
from ledger_spark.llm.order import numbered

BLOCK = 32
DELETE, REROLE, INSERT, CUT = 2, 1, 5, 5
INF = 1 << 60

#: States: nothing kept yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What each state costs at the end of a conversation, and the turns that close it.
CLOSING = (0, 2 * INSERT, INSERT, 0)
_TAIL = ("", "ua", "a", "")
#: The state that a user or an assistant turn leads to from each state, and its letter when inserted.
_NEXT = ((USER, "u"), (USER, "u"), (ASSISTANT, "a"), (USER, "u"))
_INITIAL = {"s": 0, "u": 1, "a": 2}
_SYMBOLS = "DIKR"


def _arcs(kind: int) -> list[list[tuple[str, str, int, int, int]]]:
    """For each state, the arcs out of a node before a row of this kind: (letter, symbol, cost, rows, state).

    kind: 4 * initial (s, u, a, other) + 2 * (must go) + (cut off).
    """
    initial, must_go, cut = kind >> 2, bool(kind & 2), CUT * (kind & 1)
    out = []
    for state in range(4):
        after, turn = _NEXT[state]
        arcs = [("D", "D", DELETE, 1, state), ("I", turn, INSERT, 0, after)]
        if not must_go:
            if (initial == 0 and state == START) or initial == (1 if turn == "u" else 2):
                arcs.append(("K", "K", cut, 1, SYSTEM if initial == 0 else after))
            arcs.append(("R", turn.upper(), REROLE + cut, 1, after))
        out.append(sorted(arcs))
    return out


_ARCS = [_arcs(kind) for kind in range(16)]


class Lattice:
    """One block's nodes, priced for given costs of its four exit states."""

    def __init__(self, kinds: list[int], exits: list[int]):
        self.kinds, self.exits, self.end = kinds, exits, 4 * (len(kinds) + 1)
        floor = min(exits)
        prices = [floor] * 4
        for kind in reversed(kinds):        # a row that must go or is cut off costs 2 at least: a first price below every path
            prices = [prices[0] + (DELETE if kind & 3 else 0)] * 4 + prices
        self.price = prices + [0]
        self.reached: list[bool] | None = None
        # a node without any way to the end would be raised for ever
        for node, ok in enumerate(self._reach(tight=False)):
            if not ok:
                self.price[node] = INF

    def out(self, node: int) -> list[tuple[str, str, int, int]]:
        """The arcs out of a node: (letter, symbol, cost, node)."""
        i, state = divmod(node, 4)
        if i == len(self.kinds):
            return [("", "", self.exits[state], self.end)] if self.exits[state] < INF else []
        return [(letter, symbol, cost, 4 * (i + rows) + to) for letter, symbol, cost, rows, to in _ARCS[self.kinds[i]][state]]

    def solve(self, origin: int) -> int:
        """The least cost from a state at the block's start to the end, or INF; prices stay for the next origin."""
        price, path = self.price, [origin]
        while path[-1] != self.end:
            node = path[-1]
            best, to = INF, -1
            for _, _, cost, head in self.out(node):
                if cost + price[head] < best:
                    best, to = cost + price[head], head
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
                elif best >= INF:
                    return INF
            elif best >= INF:
                return INF
            else:
                path.append(to)
        self.reached = None
        return price[origin]

    def _reach(self, tight: bool) -> list[bool]:
        """Which nodes come to the end, over tight arcs alone or over any."""
        price = self.price
        ok = [False] * self.end + [True]
        for i in range(len(self.kinds), -1, -1):
            for _ in range(3):              # at most two inserted turns follow each other
                for node in range(4 * i, 4 * i + 4):
                    ok[node] = ok[node] or any(
                        ok[head] and (not tight or price[node] == cost + price[head]) for _, _, cost, head in self.out(node))
        return ok

    def trace(self, origin: int) -> tuple[list[str], int]:
        """The symbols of each row of the cheapest path with the least letters, and its exit state."""
        self.reached = self.reached or self._reach(tight=True)
        steps, at, node = [""] * len(self.kinds), 0, origin
        while True:
            letter, symbol, _, head = next(a for a in self.out(node)
                                           if self.price[node] == a[2] + self.price[a[3]] and self.reached[a[3]])
            if head == self.end:
                return steps, node % 4
            steps[at] += symbol
            at += letter != "I"
            node = head


def _between(kinds: list[int]) -> list[int]:
    """The cheapest costs from each entry state to each exit state, by rows of four."""
    costs = [[0] * 4 for _ in range(4)]
    for leave in range(4):
        lattice = Lattice(kinds, [0 if s == leave else INF for s in range(4)])
        for enter in range(4):
            costs[enter][leave] = lattice.solve(enter)
    return [c for row in costs for c in row]


def _chain_back(entry: list[int], after: list[int]) -> list[int]:
    """What each state costs before a block, from its costs between states and what each exit costs."""
    return [min(min(entry[4 * s + t] + after[t] for t in range(4)), INF) for s in range(4)]


def _same(keys: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def _flagged(rows: DataFrame) -> DataFrame:
    """The rows in order, with their place, block and first fault; written once."""
    placed, sizes = numbered(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "repair-order", "at")
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    placed = placed.withColumn("said", said)
    first = placed.groupBy("conv_id", "said").agg(F.min("at").alias("first"))
    known = (placed.alias("r").join(first.alias("f"), _same(["conv_id", "said"], "r", "f")).select("r.*", "f.first").alias("r")
             .join(sizes.alias("s"), _same(["conv_id"], "r", "s")).select("r.*", "s.n"))
    blank, again = F.length(end) == 0, F.col("at") > F.col("first")
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    flags = known.select("conv_id", "turn", "role", "text", "at", "n", F.expr(f"at div {BLOCK}").alias("block"), code.alias("code"),
                         blank.alias("blank"), (~blank & again).alias("duplicate"),
                         (~blank & ~again & ~F.substring(end, -1, 1).isin(".", "!", "?")).alias("truncated"))
    must_go = (F.col("blank") | F.col("duplicate")).cast("int")
    return store(flags.withColumn("kind", F.col("code") * 4 + must_go * 2 + F.col("truncated").cast("int")), "repair-rows")


def _blocks(rows: DataFrame) -> DataFrame:
    """One row per block: its rows' kinds in order, and the last initial before it (null at the start)."""
    in_next = (F.col("at") % BLOCK == BLOCK - 1) & (F.col("at") + 1 < F.col("n"))
    parts = rows.select("conv_id", "n", "at", "kind", F.explode(
        F.when(in_next, F.array("block", F.col("block") + 1)).otherwise(F.array("block"))).alias("block"))
    own = F.expr(f"at div {BLOCK}") == F.col("block")
    packed = parts.groupBy("conv_id", "block").agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.when(own, F.struct("at", "kind")))).alias("members"),
        F.max(F.when(~own, F.expr("kind div 4"))).alias("before"))
    return store(packed.select("conv_id", "block", "n", F.col("members.kind").alias("kinds"), "before"), "repair-blocks")


def _per_row(df: DataFrame, fn, columns: dict[str, pa.DataType], schema: str) -> DataFrame:
    """Columns made by ``fn`` from every row of ``df`` (a dict), next to conv_id, block and n."""
    kind = df.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fn(row) for row in batch.to_pylist()]
            keep = [batch.column("conv_id"), batch.column("block"), batch.column("n")]
            yield pa.RecordBatch.from_arrays(keep + [pa.array([m[c] for m in made], t) for c, t in columns.items()],
                                             names=["conv_id", "block", "n", *columns])

    return df.mapInArrow(run, f"conv_id {kind}, block long, n long, {schema}")


def _streamed(df: DataFrame, order: list[Column], start, step, columns: dict[str, pa.DataType], schema: str) -> DataFrame:
    """``step(state, row)`` along the blocks of each conversation in one direction; one state is held at a time."""
    kind = df.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun, state = None, False, None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if not begun or row["conv_id"] != conv:
                    conv, begun, state = row["conv_id"], True, start
                out, state = step(state, row)
                made.append(out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("block")] + [pa.array([m[c] for m in made], t) for c, t in columns.items()],
                names=["conv_id", "block", *columns])

    return (df.repartition("conv_id").sortWithinPartitions("conv_id", *order)
            .mapInArrow(run, f"conv_id {kind}, block long, {schema}"))


_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _solve_block(row: dict) -> dict:
    """The traces from every entry state (of a conversation's only block: from the start), and illegal neighbours."""
    kinds, exits = row["kinds"], row["exits"] or list(CLOSING)
    last = (row["block"] + 1) * BLOCK >= row["n"]
    lattice = Lattice(kinds, [INF if e is None else e for e in exits])
    costs, steps, ends = [], [], []
    for enter in range(4) if row["n"] > BLOCK else (START,):
        cost = lattice.solve(enter)
        if cost >= INF:
            costs.append(None), steps.append(None), ends.append(None)
            continue
        path, leave = lattice.trace(enter)
        if last:
            path[-1] += _TAIL[leave]
        costs.append(cost), steps.append(path), ends.append(leave)
    initials = [] if row["before"] is None else [row["before"]]
    initials += [k >> 2 for k in kinds]
    return {"costs": costs, "steps": steps, "ends": ends,
            "illegal": sum((a, b) not in _LEGAL for a, b in zip(initials, initials[1:]))}


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(audits, edits): one row per conversation, and one per edit.

    audits: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (the edits' letters).
    edits: conv_id, at and step (their order), edit (K, R, D, I), role, text (of what stays; null if deleted).
    """
    space = F.lit(" ")
    rows = _flagged(conversations.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), space).alias("role"), F.coalesce(F.col(text_col).cast("string"), space).alias("text")))
    blocks = _blocks(rows)
    long = blocks.where(F.col("n") > BLOCK)

    between = store(_per_row(long, lambda row: {"between": _between(row["kinds"])}, {"between": pa.list_(pa.int64())},
                             "between array<long>"), "repair-between")
    exits = _streamed(between, [F.col("block").desc()], list(CLOSING),
                      lambda after, row: ({"exits": after}, _chain_back(row["between"], after)),
                      {"exits": pa.list_(pa.int64())}, "exits array<long>")
    solved = store(_per_row(
        blocks.alias("b").join(exits.alias("e"), _same(["conv_id", "block"], "b", "e"), "left").select("b.*", "e.exits"),
        _solve_block, {"costs": pa.list_(pa.int64()), "steps": pa.list_(pa.list_(pa.string())), "ends": pa.list_(pa.int32()),
                       "illegal": pa.int64()},
        "costs array<long>, steps array<array<string>>, ends array<int>, illegal long"), "repair-solved")
    entries = _streamed(solved.where(F.col("n") > BLOCK).select("conv_id", "block", "ends"), [F.col("block")], START,
                        lambda enter, row: ({"enter": enter}, row["ends"][enter]), {"enter": pa.int32()}, "enter int")
    path = store(solved.alias("p").join(entries.alias("e"), _same(["conv_id", "block"], "p", "e"), "left")
                 .withColumn("from", F.coalesce("e.enter", F.lit(START)))
                 .select("p.conv_id", "p.block", "p.illegal", F.col("p.steps")[F.col("from")].alias("steps"),
                         F.when(F.col("p.block") == 0, F.col("p.costs")[START]).alias("cost")), "repair-path")

    turns = (rows.groupBy("conv_id", "turn").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")])
             .groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
                                     F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")))
    letters = F.translate(F.array_join("steps", ""), "uaUA", "IIRR")
    audits = path.groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"), F.max("cost").alias("cost"),
        F.sort_array(F.collect_list(F.struct("block", letters.alias("letters")))).alias("parts"))
    audits = (turns.alias("t").join(audits.alias("a"), _same(["conv_id"], "t", "a"))
              .select("t.conv_id", "t.gaps", "t.blank", "t.duplicate", "t.truncated", "a.illegal", "a.cost",
                      F.array_join("a.parts.letters", "").alias("audit")))

    done = rows.alias("r").join(path.select("conv_id", "block", "steps").alias("p"), _same(["conv_id", "block"], "r", "p"))
    symbol = F.col("symbol")
    edits = (done.select("r.conv_id", "r.at", "r.role", "r.text",
                         F.posexplode(F.split(F.element_at("p.steps", (F.col("r.at") % BLOCK + 1).cast("int")), "")).alias("step", "symbol"))
             .select("conv_id", "at", "step", F.translate(symbol, "uaUA", "IIRR").alias("edit"),
                     F.when(symbol.isin("u", "U"), "user").when(symbol.isin("a", "A"), "assistant").when(symbol == "K", F.col("role")).alias("role"),
                     F.when(symbol.isin("u", "a"), "").when(symbol != "D", F.col("text")).alias("text")))
    return audits, edits


def digests(edits: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256: the hash of what stays, a line ``role:text`` per turn; texts are streamed."""
    kind = edits.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, lines, id_type = None, None, 0, None

        def out(values):
            return pa.RecordBatch.from_arrays([pa.array([v[0] for v in values], id_type), pa.array([v[1] for v in values], pa.string())],
                                              names=["conv_id", "repaired_sha256"])

        for batch in batches:
            id_type, made = batch.schema.field("conv_id").type, []
            for this, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if state is None or this != conv:
                    if state is not None:
                        made.append((conv, state.hexdigest()))
                    conv, state, lines = this, hashlib.sha256(), 0
                if role is not None:
                    state.update((("\n" if lines else "") + f"{role}:{text}").encode())
                    lines += 1
            if made:
                yield out(made)
        if state is not None:
            yield out([(conv, state.hexdigest())])

    return (edits.repartition("conv_id").sortWithinPartitions("conv_id", "at", "step").select("conv_id", "role", "text")
            .mapInArrow(run, f"conv_id {kind}, repaired_sha256 string"))


def damage(conversations: DataFrame) -> DataFrame:
    """Plants faults by crc32 of ``conv_id:turn`` (null: one space) modulo 20: a row is dropped, emptied, loses its
    sentence ends, is repeated, or becomes a user's."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    return conversations.withColumn("_fault", fault).where("_fault <> 0").select(
        "conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")
