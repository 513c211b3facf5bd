"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

A text's words give n-grams in two views: the words as written and their shapes
(runs of one kind of character as one; a word equal to the one before is a shape of
its own).  Every n-gram of a view hashes to one of ``buckets`` weights and counts
its share of the view, so a score is a sparse dot product whatever the length.

The fit takes a bounded sample of labelled rows (``rows_per_class``, ``longest``) to
one task; weights go out with the scoring function (``buckets`` doubles).

Edge cases: a null or empty text has no n-grams and gets the bias' score; without
labelled rows every score is 0.5; ties and repeated rows score alike; extra columns
pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_spark.llm import words as W
from ledger_spark.llm.labels import fit_on_sample

BUCKETS = 1 << 18
ROWS_PER_CLASS = (2500, 2500)     # of label 0, of label 1
LONGEST = 20_000
EPOCHS = 4
SCALE = 10.0

_KIND = np.arange(256, dtype=np.uint8)
_KIND[48:58] = ord("0")
_KIND[65:91] = ord("A")
_KIND[97:123] = ord("a")
_KIND[128:] = ord("a")


def _shapes(part: W.Slice, hashes: np.ndarray) -> np.ndarray:
    """A hash of each word's shape; a repeat of the word before it is one shape."""
    kind = _KIND[part.data]
    fresh = np.ones(len(kind), bool)
    if len(kind):
        fresh[1:] = kind[1:] != kind[:-1]
        fresh[part.starts] = True
    place = np.cumsum(fresh)
    short = kind[fresh]
    starts = place[part.starts] - 1
    ends = place[part.ends - 1]
    shape = W.Slice(0, 0, short, part.offsets, starts, ends, part.bounds).hashes(False)
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    shape[again] = 1
    return shape


def features(part: W.Slice, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each view and n: the bucket of each n-gram and the number of its text in the slice."""
    hashes, owner = part.hashes(False), part.text_of_word()
    for view, sequence in enumerate((hashes, _shapes(part, hashes))):
        for n in (1, 2, 3) if view else (1, 2):
            keep = W.inside(part.bounds, n, len(sequence))
            grams = W.grams(sequence, n)[keep] + np.uint64(7919 * view + n)
            yield (W.mix(grams) % np.uint64(buckets)).astype(np.int64), owner[:len(keep)][keep]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for part in W.slices(texts):
            n = part.hi - part.lo
            logit = np.full(n, self.bias)
            for at, owner in features(part, len(self.weights)):
                total = np.bincount(owner, self.weights[at], n)
                logit += SCALE * total / np.maximum(np.bincount(owner, minlength=n), 1)
            out[part.lo:part.hi] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return out


def fit(texts: pa.Array, labels: list[int], buckets: int = BUCKETS, epochs: int = EPOCHS, alpha: float = 0.3,
        beta: float = 1.0, l1: float = 0.002, l2: float = 0.001, seed: int = 7) -> Model:
    """Follow-the-regularised-leader over the rows in a fixed random order."""
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for part in W.slices(texts):
        views = list(features(part, buckets))
        for i in range(part.hi - part.lo):
            ids, values = [np.zeros(0, np.int64)], [np.zeros(0)]
            for at, owner in views:
                mine = at[np.searchsorted(owner, i):np.searchsorted(owner, i + 1)]
                if len(mine):
                    key, count = np.unique(mine, return_counts=True)
                    ids.append(key)
                    values.append(SCALE * count / len(mine))
            key, back = np.unique(np.concatenate(ids), return_inverse=True)
            rows.append((key, np.bincount(back, np.concatenate(values), len(key))))
    z, n = np.zeros(buckets + 1), np.zeros(buckets + 1)     # the last is the bias

    def weight(at):
        w = np.sign(z[at]) * l1 - z[at]
        return np.where(np.abs(z[at]) <= l1, 0.0, w / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at = np.append(rows[i][0], buckets)
            x = np.append(rows[i][1], 1.0)
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - labels[i]) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weight(np.arange(buckets + 1))
    return Model(w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", rows_per_class: tuple[int, int] = ROWS_PER_CLASS, longest: int = LONGEST, **options) -> Model:
    """A model from the labelled rows that ``learn`` admits."""
    return fit_on_sample(docs, labels, label, learn, rows_per_class, longest, id_col, text_col,
                         lambda texts, marks: fit(texts, marks, **options))


def score(text: Column, model: Model) -> Column:
    """The probability of label 1 for each whole text."""
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(model.scores(batch), pa.float64())
    return run(text)
