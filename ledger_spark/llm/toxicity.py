"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is an embedding of the word (those the sample holds often) plus the
mean embedding of its character trigrams, edges marked.  Windows of ``SPAN`` words,
each overlapping the next by half, run through a GRU in both directions; attention
over the positions pools a window and a logistic unit scores it.  A document's score
is that of its highest window, so a passage counts the same in a long text.

The fit takes a bounded sample of labelled rows (``rows_per_class``, ``longest``) to
one task.  At first each window has its row's label; then a row of label 1 teaches
by its highest window and those above one half only, for its other windows are like
any.  The model goes out with the scoring function (about two megabytes).

Edge cases: a null or wordless text is one empty window; without labelled rows the
score is the untrained network's; ties and repeated rows score alike; extra columns
pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_spark.llm import words as W
from ledger_spark.llm.labels import fit_on_sample

SPAN, STRIDE = 32, 16
ROWS_PER_CLASS = (3000, 1500)     # of label 0, of label 1
LONGEST = 20_000
TRIGRAMS = 1 << 16
WIDTH, HIDDEN, ATTENTION = 16, 8, 8
CALIBRATION = 4             # one in so many rows of the sample sets the scale of the scores
PLAIN_EPOCHS = 1            # first, every window has its row's label
LEAST_ROWS = 40             # a word with its own embedding occurs in so many texts of the sample
FIT_BYTES = 2 << 20         # text that a pass takes its windows from at a time
BLOCK = 1024                # windows that run through the network together

Params = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def empty_params(words: int, seed: int = 11) -> Params:
    """Random starting values; row 0 of ``word`` stands for all other words."""
    rng = np.random.default_rng(seed)
    f = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    h = HIDDEN
    return {"word": f(words + 1, WIDTH, s=0.01), "trigram": f(TRIGRAMS, WIDTH, s=0.01),
            "wx": f(WIDTH, 6 * h, s=0.4), "bx": np.zeros(6 * h, np.float32),
            "u": f(2, h, 3 * h, s=0.3),
            "wa": f(2 * h, ATTENTION, s=0.4), "ba": np.zeros(ATTENTION, np.float32), "va": f(ATTENTION, s=0.4),
            "wo": f(2 * h, s=0.4), "bo": np.zeros(1, np.float32)}


def _recurrent(p: Params) -> np.ndarray:
    """Both directions' recurrent weights as one block matrix: one product a step serves both."""
    h = HIDDEN
    block = np.zeros((2 * h, 6 * h), np.float32)
    for d in (0, 1):
        block[d * h:(d + 1) * h, d * 3 * h:(d + 1) * 3 * h] = p["u"][d]
    return block


def forward(p: Params, take, mask: np.ndarray, keep: bool = False):
    """Logits of windows; ``take(position, direction)`` gives the words' inputs z, r, c [windows, 3h] there."""
    (n, span), h = mask.shape, HIDDEN
    block = _recurrent(p)
    state = np.zeros((n, 2, h), np.float32)
    out = np.empty((n, span, 2, h), np.float32)
    both = np.empty((n, 2, 3 * h), np.float32)
    kept = []
    for t in range(span):
        back = span - 1 - t
        both[:, 0], both[:, 1] = take(t, 0), take(back, 1)
        hidden = (state.reshape(n, 2 * h) @ block).reshape(n, 2, 3 * h)
        zr = _sigmoid(both[..., :2 * h] + hidden[..., :2 * h])
        z, r, a = zr[..., :h], zr[..., h:], hidden[..., 2 * h:]
        c = np.tanh(both[..., 2 * h:] + r * a)
        step = (1 - z) * (c - state)
        live = np.stack([mask[:, t], mask[:, back]], 1)[..., None]
        if not live.all():
            step *= live
        if keep:
            kept.append((state, z, r, a, c, live))
        state = state + step
        out[:, t, 0], out[:, back, 1] = state[:, 0], state[:, 1]
    out = out.reshape(n, span, 2 * h)
    u = np.tanh(out @ p["wa"] + p["ba"])
    e = np.where(mask, u @ p["va"], -30)
    e = np.exp(e - e.max(1, keepdims=True)) * mask
    share = e / np.maximum(e.sum(1, keepdims=True), 1e-9)
    pooled = (share[:, None, :] @ out)[:, 0]
    logit = pooled @ p["wo"] + p["bo"][0]
    return (logit, (kept, out, u, share, pooled)) if keep else logit


def backward(p: Params, mask: np.ndarray, caches, dlogit: np.ndarray) -> tuple[Params, np.ndarray]:
    """Gradients of all but the embeddings, and of the words' inputs [windows, span, direction, 3h]."""
    kept, out, u, share, pooled = caches
    (n, span), h = mask.shape, HIDDEN
    block = _recurrent(p)
    g = {"wo": pooled.T @ dlogit, "bo": np.array([dlogit.sum()], np.float32)}
    dpooled = dlogit[:, None] * p["wo"]
    dout = share[:, :, None] * dpooled[:, None, :]
    dshare = (out @ dpooled[:, :, None])[..., 0]
    de = share * (dshare - (share * dshare).sum(1, keepdims=True))
    g["va"] = np.einsum("ns,nsa->a", de, u)
    du = de[:, :, None] * p["va"] * (1 - u * u)
    g["wa"] = out.reshape(n * span, -1).T @ du.reshape(n * span, -1)
    g["ba"] = du.sum((0, 1))
    dout = (dout + du @ p["wa"].T).reshape(n, span, 2, h)
    dblock = np.zeros_like(block)
    dx = np.zeros((n, span, 2, 3 * h), np.float32)
    dstate = np.zeros((n, 2, h), np.float32)
    for t in range(span - 1, -1, -1):
        state, z, r, a, c, live = kept[t]
        back = span - 1 - t
        dstate[:, 0] += dout[:, t, 0]
        dstate[:, 1] += dout[:, back, 1]
        dstep = dstate * live
        dc = dstep * (1 - z) * (1 - c * c)
        dinput = np.concatenate([-dstep * (c - state) * z * (1 - z), dc * a * r * (1 - r), dc], 2)
        dx[:, t, 0], dx[:, back, 1] = dinput[:, 0], dinput[:, 1]
        dhidden = dinput.copy()
        dhidden[..., 2 * h:] *= r
        dhidden = dhidden.reshape(n, 6 * h)
        dblock += state.reshape(n, 2 * h).T @ dhidden
        dstate = dstate - dstep * (1 - z) + (dhidden @ block.T).reshape(n, 2, h)
    g["u"] = np.stack([dblock[d * h:(d + 1) * h, d * 3 * h:(d + 1) * 3 * h] for d in (0, 1)])
    return g, dx


class Words:
    """The distinct words of a slice: embedding row and character trigrams of each."""

    def __init__(self, part: W.Slice, vocabulary: np.ndarray):
        hashes = part.hashes(True)
        self.distinct, first, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(vocabulary, self.distinct)
        known = at < len(vocabulary)
        known[known] = vocabulary[at[known]] == self.distinct[known]
        self.row = np.where(known, at + 1, 0)
        starts, ends = part.starts[first], part.ends[first]
        size = ends - starts
        self.begin = np.concatenate([[0], np.cumsum(size)])
        owner = np.repeat(np.arange(len(size)), size)
        place = np.arange(self.begin[-1]) - self.begin[owner] + starts[owner]
        text = W._LOWER[part.data].astype(np.int64)
        mid = text[place]
        left = np.where(place == starts[owner], 1, text[np.maximum(place - 1, 0)])
        right = np.where(place + 1 == ends[owner], 2, text[np.minimum(place + 1, len(text) - 1)])
        code = ((left << 16) | (mid << 8) | right).astype(np.uint64)
        self.trigram = (W.mix(code) % np.uint64(TRIGRAMS)).astype(np.int64)
        self.size = size

    def vectors(self, p: Params) -> np.ndarray:
        if not len(self.row):
            return np.zeros((0, WIDTH), np.float32)
        total = np.add.reduceat(p["trigram"][self.trigram], self.begin[:-1], axis=0)
        return p["word"][self.row] + total / 2


def windows(bounds: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of each window: every ``stride`` words, and at least one a text, until its end is covered."""
    size = np.diff(bounds)
    count = np.maximum(-(-(size - SPAN) // stride), 0) + 1
    owner = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return bounds[owner] + nth * stride, owner


def _gather(first: np.ndarray, owner: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions [windows, span] and which of them lie in the window's text."""
    at = first[:, None] + np.arange(SPAN)
    mask = at < bounds[owner + 1][:, None]
    return np.where(mask, at, 0), mask


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct row numbers and the sum of the values of each."""
    order = np.argsort(rows, kind="stable")
    keys, start = np.unique(rows[order], return_index=True)
    return keys, np.add.reduceat(values[order], start, axis=0)


class Model:
    """Parameters, the words with embeddings of their own, and the calibration (slope, offset) of a text's logit."""

    def __init__(self, params: Params, vocabulary: np.ndarray, slope: float = 1.0, offset: float = 0.0):
        self.params, self.vocabulary, self.slope, self.offset = params, vocabulary, slope, offset

    def scores(self, texts: pa.Array) -> np.ndarray:
        return _sigmoid(np.clip(self.slope * self.logits(texts) + self.offset, -30, 30))

    def logits(self, texts: pa.Array) -> np.ndarray:
        """The logit of each text's highest window."""
        p, out = self.params, np.zeros(len(texts))
        for part in W.slices(texts, blank=W.NOT_LETTERS):
            known = Words(part, self.vocabulary)
            first, owner = windows(part.bounds, STRIDE)
            best = np.full(part.hi - part.lo, -np.inf)
            np.maximum.at(best, owner, _logits(p, known, part, first, owner))
            out[part.lo:part.hi] = best
        return out


def calibrate(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic regression of the labels on the texts' logits (a little ridge on the slope)."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    mean, spread = logit.mean(), logit.std() + 1e-6
    x = np.stack([(logit - mean) / spread, np.ones_like(logit)], 1)
    w = np.zeros(2)
    for _ in range(50):
        q = _sigmoid(np.clip(x @ w, -30, 30))
        grad = x.T @ (q - y) + np.array([0.1, 0.0]) * w
        hess = (x * (q * (1 - q))[:, None]).T @ x + np.diag([0.1, 1e-6])
        w -= np.linalg.solve(hess, grad)
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def _logits(p: Params, w: Words, part: W.Slice, first: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The network's logits of windows, a block at a time."""
    inputs, word = w.vectors(p) @ p["wx"] + p["bx"], w.word
    if not len(word):
        inputs, word = np.zeros((1, 6 * HIDDEN), np.float32), np.zeros(1, np.int64)
    sides = [np.ascontiguousarray(inputs[:, d * 3 * HIDDEN:(d + 1) * 3 * HIDDEN]) for d in (0, 1)]
    out = np.empty(len(first), np.float32)
    for lo in range(0, len(first), BLOCK):
        at, mask = _gather(first[lo:lo + BLOCK], owner[lo:lo + BLOCK], part.bounds)
        ids = word[np.minimum(at, len(word) - 1)].T.copy()
        out[lo:lo + BLOCK] = forward(p, lambda t, d, ids=ids: sides[d][ids[t]], mask)
    return out


def _telling(p: Params, w: Words, part: W.Slice, jobs: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which windows to learn from: all of label 0; of a text of label 1 the highest, and those above one half."""
    logit = _logits(p, w, part, jobs[:, 1], jobs[:, 2])
    best = np.full(part.hi - part.lo, -np.inf)
    np.maximum.at(best, jobs[:, 2], logit)
    return (y[part.lo + jobs[:, 2]] == 0) | (logit >= 0) | (logit == best[jobs[:, 2]])


def fit(texts: pa.Array, labels: list[int], epochs: int = 4, batch: int = 128, rate: float = 0.005,
        seed: int = 5) -> Model:
    """Adam (embeddings: Adagrad) over the windows of the sample, in a fixed random order."""
    rng, step = np.random.default_rng(seed), 0
    mixed = rng.permutation(len(labels))
    y = np.array(labels, np.float32)[mixed]
    texts = texts.take(pa.array(mixed))
    held = len(y) // CALIBRATION if len(y) >= 10 * CALIBRATION else 0
    parts = list(W.slices(texts[held:], FIT_BYTES, W.NOT_LETTERS))
    tuned, y = y[:held].astype(np.float64), y[held:]
    seen: dict[int, int] = {}
    for part in parts:
        pairs = np.unique(np.stack([part.text_of_word().astype(np.uint64), part.hashes(True)], 1), axis=0)[:, 1]
        for key, count in zip(*(a.tolist() for a in np.unique(pairs, return_counts=True))):
            seen[key] = seen.get(key, 0) + count
    vocabulary = np.array(sorted(k for k, c in seen.items() if c >= LEAST_ROWS), np.uint64)
    p = empty_params(len(vocabulary))
    known = [Words(part, vocabulary) for part in parts]
    jobs = []
    for k, part in enumerate(parts):
        first, owner = windows(part.bounds, SPAN)
        jobs += [(k, f, o) for f, o in zip(first.tolist(), owner.tolist())]
    tables = ("word", "trigram")
    m = {k: np.zeros_like(v) for k, v in p.items() if k not in tables}
    v = {k: np.zeros_like(v) for k, v in p.items()}
    every = np.array(jobs, np.int64).reshape(-1, 3)
    for epoch in range(epochs):
        for k in rng.permutation(len(parts)):
            mine = every[every[:, 0] == k]
            part, w = parts[k], known[k]
            if not len(w.word):
                continue
            if epoch >= PLAIN_EPOCHS:
                mine = mine[_telling(p, w, part, mine, y)]
            mine = mine[rng.permutation(len(mine))]
            for lo in range(0, len(mine), batch):
                first, owner = mine[lo:lo + batch, 1], mine[lo:lo + batch, 2]
                at, mask = _gather(first, owner, part.bounds)
                ids, back = np.unique(w.word[np.minimum(at, len(w.word) - 1)], return_inverse=True)
                back = back.reshape(at.shape)
                counts = w.size[ids]
                edge = np.concatenate([[0], np.cumsum(counts)])
                tri = w.trigram[np.arange(edge[-1]) + np.repeat(w.begin[ids] - edge[:-1], counts)]
                vectors = p["word"][w.row[ids]] + np.add.reduceat(p["trigram"][tri], edge[:-1], axis=0) / 2
                x = (vectors @ p["wx"] + p["bx"]).reshape(-1, 2, 3 * HIDDEN)
                logit, caches = forward(p, lambda t, d, x=x, back=back: x[back[:, t], d], mask, keep=True)
                dlogit = ((_sigmoid(logit) - y[part.lo + owner]) / len(owner)).astype(np.float32)
                g, dx = backward(p, mask, caches, dlogit)
                _, flat = _sums(back.ravel(), dx.reshape(-1, 6 * HIDDEN))
                g["wx"], g["bx"] = vectors.T @ flat, flat.sum(0)
                dvec = flat @ p["wx"].T
                step += 1
                for name in m:
                    m[name] += 0.1 * (g[name] - m[name])
                    v[name] += 0.002 * (g[name] ** 2 - v[name])
                    p[name] -= (rate * (m[name] / (1 - 0.9 ** step)) / (np.sqrt(v[name] / (1 - 0.998 ** step)) + 1e-7)).astype(np.float32)
                for name, at, grad in (("word", w.row[ids], dvec),
                                       ("trigram", tri, np.repeat(dvec / 2, counts, axis=0))):
                    rows, total = _sums(at, grad)
                    v[name][rows] += total ** 2
                    p[name][rows] -= (5 * rate * total / (np.sqrt(v[name][rows]) + 1e-7)).astype(np.float32)
    model = Model(p, vocabulary)
    if held:
        model.slope, model.offset = calibrate(model.logits(texts[:held]), tuned)
    return model


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", id_col: str = "doc_id",
          text_col: str = "text", rows_per_class: tuple[int, int] = ROWS_PER_CLASS, longest: int = LONGEST, **options) -> Model:
    """A model from the labelled rows that ``learn`` admits."""
    return fit_on_sample(docs, labels, label, learn, rows_per_class, longest, id_col, text_col,
                         lambda texts, marks: fit(texts, marks, **options))


def score(text: Column, model: Model) -> Column:
    """The probability that a whole text is toxic: that of its highest window."""
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(model.scores(batch), pa.float64())
    return run(text)
