"""Chat formatting: a finite-state machine over roles and a declarative template.

Conversations are dealt by id and sorted by turn inside their partition, then
streamed: one turn is held at a time, however long a conversation is.  Each turn
becomes segments (text, loss flag): the role's opening mark, the escaped text, the
closing mark.  The state machine follows the roles and reports, on each segment,
whether the turn is allowed after the one before.

Escaping: a backslash before every backslash and before every control string, so
what a text says can never be read as a mark, and dropping those backslashes gives
the text back.

Edge cases: a null text is empty; a null role is the empty role; roles outside the
template are formatted as named turns and are not allowed anywhere; turns sort by
number (null first), then role, then text, repeated rows stay; a null conversation
id is one conversation; an empty table gives no segments; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks by role (open, close), which roles carry loss, and which role may follow which."""
    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    named: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")    # other roles: open, end of the role, close
    loss: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {
        "": frozenset({"system", "user"}), "system": frozenset({"user"}),
        "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})

    @property
    def control(self) -> list[str]:
        return sorted({m for pair in self.marks.values() for m in pair} | set(self.named), key=lambda m: (-len(m), m))

    def escaper(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, ["\\", *self.control])))


def segments(conversations: DataFrame, template: Template = Template(), id_col: str = "conv_id",
             turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The segments of every conversation, in order within each partition; conversations are never split."""
    kind = conversations.schema[id_col].dataType.simpleString()
    rows = (conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                                 F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                                 F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escape = template.escaper()
        at, state, n, begun = None, "", 0, False
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("conv_id", "turn", "segment", "text", "loss", "allowed")}
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
                if not begun or conv != at:
                    at, state, n, begun = conv, "", 0, True
                allowed = role in template.follows.get(state, ())
                if role in template.marks:
                    first, last = template.marks[role]
                else:
                    first = template.named[0] + escape.sub(lambda m: "\\" + m[0], role) + template.named[1]
                    last = template.named[2]
                body = escape.sub(lambda m: "\\" + m[0], text)
                for piece, loss in ((first, False), (body, role in template.loss), (last, False)):
                    out["conv_id"].append(conv)
                    out["turn"].append(turn)
                    out["segment"].append(n)
                    out["text"].append(piece)
                    out["loss"].append(loss)
                    out["allowed"].append(allowed)
                    n += 1
                state = role
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["conv_id"], batch.schema.field("conv_id").type),
                 pa.array(out["turn"], batch.schema.field("turn").type), pa.array(out["segment"], pa.int32()),
                 pa.array(out["text"], pa.string()), pa.array(out["loss"], pa.bool_()),
                 pa.array(out["allowed"], pa.bool_())], names=list(out))

    turn_kind = conversations.schema[turn_col].dataType.simpleString()
    return rows.mapInArrow(run, f"conv_id {kind}, turn {turn_kind}, segment int, text string, loss boolean, allowed boolean")


class Reader:
    """Reads a formatted conversation back, piece by piece: marks give the turns, the mask gives the loss text."""

    def __init__(self, template: Template):
        marks = sorted(template.control, key=len, reverse=True)
        self.token = re.compile(r"\\(" + "|".join(map(re.escape, ["\\", *marks])) + ")|(" + "|".join(map(re.escape, marks)) + ")")
        self.opens = {m[0]: role for role, m in template.marks.items()}
        self.closes = {m[1] for m in template.marks.values()} | {template.named[2]}
        self.named = template.named
        self.role: str | None = None
        self.naming = False
        self.parts: list[str] = []

    def feed(self, piece: str, loss: bool) -> Iterator[tuple[str, object]]:
        """Events ("turn", (role, text)) and ("loss", text) that this piece completes; a mark never spans pieces."""
        at = 0
        for m in self.token.finditer(piece):
            yield from self._plain(piece[at:m.start()], loss)
            at = m.end()
            if m[1] is not None:
                yield from self._plain(m[1], loss)
            elif m[2] in self.opens and self.role is None and not self.naming:
                self.role = self.opens[m[2]]
            elif m[2] == self.named[0] and self.role is None and not self.naming:
                self.naming = True
            elif m[2] == self.named[1] and self.naming:
                self.role, self.naming, self.parts = "".join(self.parts), False, []
            elif m[2] in self.closes and self.role is not None:
                yield "turn", (self.role, "".join(self.parts))
                self.role, self.parts = None, []
            else:
                raise ValueError(f"mark {m[2]!r} out of place")
        yield from self._plain(piece[at:], loss)

    def _plain(self, text: str, loss: bool) -> Iterator[tuple[str, object]]:
        if text:
            if self.role is None and not self.naming:
                raise ValueError("text outside a turn")
            self.parts.append(text)
            if loss:
                yield "loss", text


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of each conversation, from its segments as ``segments`` gives them (same partitions, same order)."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid")
        at, begun, schema = None, False, None

        def fresh():
            return {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "loss_n": 0, "chars": 0,
                    "valid": True, "reader": Reader(template)}

        def row(conv, s):
            if s["reader"].role is not None or s["reader"].naming:
                raise ValueError("a turn is not closed")
            return (conv, s["n"], s["turns"].hexdigest(), s["loss_n"], s["loss"].hexdigest(), s["chars"], s["valid"])

        s = fresh()
        for batch in batches:
            schema = batch.schema.field("conv_id").type
            done = []
            for conv, piece, loss, allowed in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "allowed"))):
                if begun and conv != at:
                    done.append(row(at, s))
                    s = fresh()
                at, begun = conv, True
                s["chars"] += len(piece)
                s["valid"] &= allowed
                for what, value in s["reader"].feed(piece, loss):
                    if what == "turn":
                        s["n"] += 1
                        s["turns"].update(f"{value[0]}\n{value[1]}\n".encode())
                    else:
                        s["loss_n"] += len(value)
                        s["loss"].update(value.encode())
            if done:
                yield batch_of(done, names, schema)
        if begun:
            yield batch_of([row(at, s)], names, schema)

    def batch_of(rows, names, id_type):
        types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names))

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                     "loss_sha256 string, formatted_chars long, valid boolean")
