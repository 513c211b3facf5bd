"""BPE encoding and decoding over a table of distinct words.

Texts are split into words in Spark tasks, a run of texts (``CHUNK`` characters) at a
time; a chunk keeps its distinct words and, for every position, a word's number.  The
chunks' words are dealt by word and sorted: there each distinct word of the whole input
is encoded once, decoding joins its ids with the vocabulary's pieces (as many rows as the
vocabulary has, broadcast), and both go back to the chunks that asked, packed.  Chunks
then put ids and pieces in place by position.

What crosses the network is a chunk's packed positions and its distinct words; texts
do not.  A frequent word is one row per chunk, so no key is hot.

A word is what the vocabulary's own splitter cuts; the added tokens (``<|endoftext|>``)
are words of their own, cut out first.  The splitter's pattern is run by ``regex`` on
texts whose characters both class alike (``PLAIN``, tested); other texts go through
the tokenizer's own splitter, which is slower.

Edge cases: a null text is empty and has no ids; repeated rows and ids are kept, since
rows are matched by position, never by id; a null id stays null; a very long text makes
a chunk of its own, a very long word is one row; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledger_spark.llm.words import release

#: Characters of text in one chunk.
CHUNK = 1 << 25
#: Fixed value: the word pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters only are split by ``regex``; beyond them its Unicode version may differ from the tokenizer's.
PLAIN = "\\x00-\u052f\u2010-\u205e\u20a0-\u20ab\u3000-\u3003\u4e00-\u9fa5"


@lru_cache(maxsize=4)
def _tokenizer(vocabulary: str) -> Tokenizer:
    """The tokenizer of a vocabulary file's text."""
    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Splitter:
    """Cuts a text into the vocabulary's words; together they are the text."""

    def __init__(self, vocabulary: str):
        self.tokenizer = _tokenizer(vocabulary)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=lambda t: (-len(t), t))
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.words = regex.compile(PATTERN)
        self.unusual = regex.compile(f"[^{PLAIN}]")

    def _plain(self, text: str) -> list[str]:
        if self.unusual.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.words.findall(text)

    def __call__(self, text: str) -> list[str]:
        if self.added is None or not self.added.search(text):
            return self._plain(text)
        out = []
        for i, part in enumerate(self.added.split(text)):
            out += [part] if i % 2 else self._plain(part)
        return out


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers, byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class _Chunk:
    """Texts gathered by a task: ids, words per text, and each position's word number."""

    def __init__(self):
        self.ids, self.sizes, self.parts, self.words, self.chars = [], [], [], {}, 0

    def add(self, row_id, text: str, words: list[str]) -> None:
        number = self.words
        codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint32, len(words))
        self.ids.append(row_id)
        self.sizes.append(len(words))
        self.parts.append(codes)
        self.chars += len(text)

    def row(self) -> dict:
        """Words are renumbered by how often they occur, so that positions pack well."""
        codes = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint32)
        order = np.argsort(-np.bincount(codes, minlength=len(self.words)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        words = list(self.words)
        return {"ids": self.ids, "sizes": self.sizes, "codes": _pack(rank[codes]),
                "words": zstandard.ZstdCompressor(level=3).compress(json.dumps([words[i] for i in order], ensure_ascii=False).encode())}


def _chunks(docs: DataFrame, vocabulary: Broadcast, id_col: str, text_col: str, chunk_chars: int) -> DataFrame:
    """chunk, ids, sizes, codes, words: dealt by chunk; one number per chunk, the same on every run of a task."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held, n = Splitter(vocabulary.value), _Chunk(), 0
        part, id_type = TaskContext.get().partitionId(), None

        def out():
            row = held.row()
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + n], pa.int64()), pa.array([row["ids"]], pa.list_(id_type)), pa.array([row["sizes"]], pa.list_(pa.int64())),
                 pa.array([row["codes"]], pa.binary()), pa.array([row["words"]], pa.binary())],
                names=["chunk", "ids", "sizes", "codes", "words"])

        for batch in batches:
            id_type = batch.schema.field("id").type
            for row_id, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                held.add(row_id, text, split(text))
                if held.chars >= chunk_chars:
                    yield out()
                    held, n = _Chunk(), n + 1
        if held.ids:
            yield out()
        held = None
        release()

    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return (thin.mapInArrow(run, f"chunk long, ids array<{kind}>, sizes array<long>, codes binary, words binary")
            .repartition("chunk"))


def _requests(chunks: DataFrame) -> DataFrame:
    """word, chunk, code: a row for every distinct word of every chunk, dealt by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("words")):
                words = json.loads(zstandard.ZstdDecompressor().decompress(data.as_py()))
                for lo in range(0, len(words), 10_000):
                    some = words[lo:lo + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, pa.string()), pa.array(np.full(len(some), chunk)), pa.array(np.arange(lo, lo + len(some)))],
                        names=["word", "chunk", "code"])
        release()

    return chunks.mapInArrow(run, "word string, chunk long, code long").repartition("word")


def _encoded(requests: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """chunk, code, at, id: the ids of each requested word, in order.

    The requests for a word lie together, sorted, so each distinct word is encoded once; a word asked for
    by many chunks goes out with as many of them as an Arrow batch holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, last, tokens = _tokenizer(vocabulary.value), None, []
        for batch in batches:
            runs = pc.run_end_encode(batch.column("word"))
            words = runs.values.to_pylist()
            new = words[1:] if words and words[0] == last else words
            coded = [e.ids for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            if len(new) < len(words):
                coded.insert(0, tokens)
            if words:
                last, tokens = words[-1], coded[-1]
            bounds = pa.array(np.concatenate([[0], runs.run_ends.to_numpy()]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(coded, pa.list_(pa.int32()))] + [
                pa.ListArray.from_arrays(bounds, batch.column(c)) for c in ("chunk", "code")], names=["tokens", "chunk", "code"])
        release()

    table = requests.sortWithinPartitions("word").mapInArrow(run, "tokens array<int>, chunk array<long>, code array<long>")
    asked = table.select("tokens", F.explode(F.arrays_zip("chunk", "code")).alias("asked"))
    return asked.select("asked.chunk", "asked.code", F.posexplode("tokens").alias("at", "id"))


def pieces(spark: SparkSession, vocabulary: str) -> DataFrame:
    """id, piece: the vocabulary's bytes by id, one row per id."""
    tokenizer = _tokenizer(vocabulary)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(visible)))}
    added = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    rows = {i: added[i] if i in added else bytes(byte_of[c] for c in token) for token, i in tokenizer.get_vocab(with_added_tokens=True).items()}
    return spark.createDataFrame(pa.table({"id": pa.array(list(rows), pa.int32()), "piece": pa.array(list(rows.values()), pa.binary())}))


_ANSWER = ("codes", "counts", "tokens", "lengths", "letters")


def _packed(answers: DataFrame) -> DataFrame:
    """The answers of a task to each chunk as one row: word numbers, ids per word, ids, bytes per word, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[pa.RecordBatch]):
            one = pa.Table.from_batches(rows)
            codes, ids, spelled = (pa.concat_arrays(one.column(c).chunks) for c in ("code", "id", "piece"))
            codes, sizes = codes.to_numpy(), pc.binary_length(spelled).to_numpy()
            begin = np.flatnonzero(np.diff(codes, prepend=-1))
            values = (_pack(np.diff(codes[begin], prepend=0)), _pack(np.diff(begin, append=len(codes))), _pack(ids.to_numpy()),
                      _pack(np.add.reduceat(sizes, begin)), zstandard.compress(b"".join(spelled.to_pylist())))
            return pa.RecordBatch.from_arrays([one.column("chunk").slice(0, 1).combine_chunks(), *(pa.array([v], pa.binary()) for v in values)],
                                              names=["chunk", *_ANSWER])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if held and held[0].column("chunk")[0].as_py() != chunks[lo]:
                        yield flush(held)
                        held = []
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield flush(held)
        held = []
        release()

    return (answers.sortWithinPartitions("chunk", "code", "at").select("chunk", "code", "id", "piece")
            .mapInArrow(run, "chunk long, " + ", ".join(f"{c} binary" for c in _ANSWER)))


def _gather(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``first``, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(first - ends + sizes, sizes) + np.arange(sizes.sum())]


def _table(answers: list[dict], sizes: str, values: str, unpack) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All values of the answers, and for each word number where its own begin and how many they are."""
    codes = [np.cumsum(_unpack(a["codes"]), dtype=np.int64) for a in answers]
    counts = [_unpack(a[sizes]).astype(np.int64) for a in answers]
    code, count = (np.concatenate([np.zeros(0, np.int64), *parts]) for parts in (codes, counts))
    first, size = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    if len(code):
        if len(np.unique(code)) != len(code) or code.max() != len(code) - 1:
            raise ValueError("a word of the chunk has no answer, or two")
        first[code], size[code] = np.cumsum(count) - count, count
    return np.concatenate([unpack(b""), *(unpack(a[values]) for a in answers)]), first, size


def _ids(data: bytes) -> np.ndarray:
    return (_unpack(data) if data else np.zeros(0)).astype(np.int32)


def _letters(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data) if data else b"", np.uint8)


def _placed(chunks: DataFrame, answers: DataFrame, id_col: str, kind: str) -> DataFrame:
    """Every text's ids and decoded text, from its chunk's positions and the answers to the chunk's words."""

    def run(chunk: pa.Table, known: pa.Table) -> pa.Table:
        replies = known.to_pylist()
        ids, id_first, id_size = _table(replies, "counts", "tokens", _ids)
        letters, first, size = _table(replies, "lengths", "letters", _letters)
        ids_out, tokens_out, texts = [], [], []
        for row_ids, sizes, packed in zip(*(chunk.column(c).to_pylist() for c in ("ids", "sizes", "codes"))):
            codes, at = _unpack(packed).astype(np.int64), 0
            for row_id, words in zip(row_ids, sizes):
                own = codes[at:at + words]
                at += words
                tokens_out.append(_gather(ids, id_first[own], id_size[own]))
                texts.append(_gather(letters, first[own], size[own]).tobytes().decode("utf-8", "replace"))
                ids_out.append(row_id)
        starts = np.cumsum([0, *map(len, tokens_out)], dtype=np.int32)
        values = np.concatenate([np.zeros(0, np.int32), *tokens_out])
        out = pa.table({id_col: pa.array(ids_out, chunk.schema.field("ids").type.value_type),
                        "ids": pa.ListArray.from_arrays(pa.array(starts), pa.array(values)), "decoded": pa.array(texts, pa.string())})
        del replies, ids, letters, tokens_out, texts, values
        release()
        return out

    return (chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
            .applyInArrow(run, f"{id_col} {kind}, ids array<int>, decoded string"))


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                  chunk_chars: int = CHUNK) -> DataFrame:
    """id_col, ids and decoded (the text that the ids stand for) of every row."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))
    chunks = _chunks(docs, vocabulary, id_col, text_col, chunk_chars)
    spelled = _encoded(_requests(chunks), vocabulary).join(F.broadcast(pieces(spark, vocabulary.value)), "id")
    return _placed(chunks, _packed(spelled), id_col, docs.schema[id_col].dataType.simpleString())
