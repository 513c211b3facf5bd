"""The models: gradients against differences, held-out accuracy, base counts against brute force; and the pipeline."""

import collections
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledger_spark.llm import lm, quality, toxicity
from ledger_spark.llm import words as W
from ledger_spark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_word_hashes_follow_the_words():
    texts = pa.array(["a B  a", None, "", "É\u00a0é b\x0bc", "b"])
    parts = list(W.slices(texts, size=3))
    assert [len(p.starts) for p in parts] and sum(len(p.starts) for p in parts) == 7
    by = {}
    for p in parts:
        for h, s, e in zip(p.hashes(False).tolist(), p.starts, p.ends):
            by.setdefault(bytes(p.data[s:e]), set()).add(h)
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)


def _difference(loss, array, at, step=1e-4):
    old = array[at]
    array[at] = old + step
    up = loss()
    array[at] = old - step
    down = loss()
    array[at] = old
    return (up - down) / (2 * step)


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.empty_params(3).items()}
    x = rng.standard_normal((4, toxicity.SPAN, 2, 3 * toxicity.HIDDEN))
    mask = np.arange(toxicity.SPAN) < np.array([[32], [5], [0], [20]])
    weight = rng.standard_normal(4)
    run = lambda: float(toxicity.forward(p, lambda t, d: x[:, t, d], mask) @ weight)
    _, caches = toxicity.forward(p, lambda t, d: x[:, t, d], mask, keep=True)
    g, dx = toxicity.backward(p, mask, caches, weight)
    for name, at in (("u", (0, 2, 3)), ("u", (1, 1, 20)), ("wa", (3, 2)), ("ba", (1,)), ("va", (4,)), ("wo", (9,))):
        assert abs(_difference(run, p[name], at) - g[name][at]) < 1e-3
    for at in ((0, 30, 0, 1), (0, 2, 1, 23), (1, 4, 1, 9)):
        assert abs(_difference(run, x, at) - dx[at]) < 1e-3


def test_language_model_gradients_and_normalisation():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in lm.new_params(62).items()}
    tokens = np.append(rng.integers(0, 62, 70), 62).astype(np.int16)
    ids, targets, _ = lm.windows_of(tokens, np.array([71]), 62)
    assert (targets >= 0).sum() == 71 and targets[targets >= 0].tolist() == tokens.tolist()
    flat, weight = np.maximum(targets, 0), targets >= 0
    _, g = lm.gradients(p, ids, flat, weight)
    for name, at in (("e", (int(ids[1, 20]), 3)), ("pos", (20, 2)), ("wq", (1, 2)), ("wk", (3, 4)), ("wv", (5, 6)),
                     ("w1", (2, 3)), ("wc", (1, int(tokens[0]) % lm.CLASSES))):
        assert abs(_difference(lambda: lm.gradients(p, ids, flat, weight)[0], p[name], at) - g[name][at]) < 1e-4
    lm.unigram_bias(p, np.ones(63))
    hidden = lm.attend(p, ids)[:1]
    every = [float(np.exp(lm.log_probabilities(p, hidden, np.array([i]))[0])) for i in range(63)]
    assert abs(sum(every) - 1) < 1e-3


def test_each_place_sees_only_what_is_before():
    p = lm.new_params(62)
    a = np.random.default_rng(1).integers(0, 62, 48).astype(np.int16)
    b = a.copy()
    b[40:] = 5
    ids = [lm.windows_of(x, np.array([48]), 62)[0] for x in (a, b)]
    h = [lm.attend(p, i).reshape(-1, lm.WIDTH) for i in ids]
    assert np.allclose(h[0][:41], h[1][:41], atol=1e-5) and not np.allclose(h[0][41:], h[1][41:])


def test_quality_on_held_out_rows(spark):
    rows = QUERIES["op2_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.95
    empty = quality.Model(np.zeros(8), 0.0)
    assert empty.scores(pa.array(["", None, "a"])).tolist() == [0.5, 0.5, 0.5]
    assert len(quality.fit(pa.array([], pa.string()), []).scores(pa.array([None, "x"]))) == 2


def test_toxicity_learns_a_word_and_finds_it_in_a_long_text():
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    text = lambda bad: " ".join("vexing" if bad and i % 40 == 7 else word() for i in range(120))
    labels = [0, 1] * 150
    model = toxicity.fit(pa.array([text(y) for y in labels]), labels, epochs=6)
    long = " ".join(word() for _ in range(3000))
    scores = model.scores(pa.array([long, long + " vexing " + long, "", None, text(1), text(0)]))
    assert scores[1] > 0.7 > scores[0] and scores[4] > scores[5] and scores[2] == scores[3] and ((scores >= 0) & (scores <= 1)).all()


def test_language_model_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs = docs.union(spark.createDataFrame([(900, None, "en", "s", 0), (901, " ", "en", "s", 0), (901, "Zz\u00e9 zz", "en", "s", 0)], docs.schema))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    counts, n = collections.Counter(), 0
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update((text or "").encode().lower().split())
            n += 1
    total, distinct = sum(counts.values()) + n, len(counts) + 1
    base = lambda c: math.log10((c + 1) / (total + distinct + 1))
    want = sorted((i, len(w) + 1, sum(counts[x] > 0 for x in w) + 1, round(sum(base(counts[x]) for x in w) + base(n), 6))
                  for i, w in ((i, (t or "").encode().lower().split()) for i, t in rows))
    old, lm.COMMON = lm.COMMON, 20            # most words then come by the join
    try:
        got = lm.score_texts(docs, held).collect()
    finally:
        lm.COMMON = old
    assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == total and r.score < 0 for r in got)


def test_language_model_learns_from_every_window(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(500)]
    texts = [" ".join(rng.choice(words, n)) for n in [*rng.integers(1, 2000, 200).tolist(), 30_000]] + ["", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    ranks = lm.read_ranks(lm.VOCABULARY, lm.IDS)
    encode, end = lm.encoder(ranks), len(ranks)
    want = collections.Counter()
    for text in texts:
        tokens = np.append(np.frombuffer(b"".join(encode(w) for w in text.encode().split()), np.int16), end)
        ids, targets, _ = lm.windows_of(tokens, np.array([len(tokens)]), end)
        want.update(w.tobytes() for w in np.concatenate([ids, targets], 1).astype(np.int16))
    counts, trained = lm.word_counts(docs.select("text")), []

    def keep(p, data, *_):
        trained.append(data)
        return p
    monkeypatch.setattr(lm, "adam", keep)
    one = type(docs).mapInArrow

    def here(self, func, schema):           # the training tasks run in this process
        if schema != "weights array<double>":
            return one(self, func, schema)
        parts = [pa.Table.from_batches([b]).to_batches() for b in self.toArrow().to_batches()]
        rows = [w for part in parts for b in func(iter(part)) for w in b.column("weights").to_pylist()]
        return spark.createDataFrame([(r,) for r in rows], schema)
    monkeypatch.setattr(type(docs), "mapInArrow", here)
    lm.fit(docs, counts, len(texts), ranks)
    got = collections.Counter(w.tobytes() for data in trained for w in data)
    assert got == want and sum(want.values()) > lm.SHARD_WINDOWS * lm.ROUNDS


def test_pipeline_drops_near_duplicates_by_row(spark):
    import corpus_pipeline
    rng = np.random.default_rng(7)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    a, b, c, d = (words(80) for _ in range(4))
    near = a[:-1] + ["else"]
    texts = [(1, a), (5, near), (5, b), (5, b), (None, c), (None, c), (None, near), (3, d), (3, c), (9, []), (9, [])]
    rows = [(i, " ".join(t)) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    grams = [{tuple(t[j:j + 5]) for j in range(len(t) - 4)} for _, t in texts]
    group = list(range(len(rows)))
    for i, x in enumerate(grams):
        for j, y in enumerate(grams[:i]):
            if x and y and len(x & y) * 100 >= 80 * len(x | y):
                group = [group[j] if g == group[i] else g for g in group]
    want = []
    for g in set(group):
        ids = [r for r, own in zip(rows, group) if own == g]
        want.append(min(ids, key=lambda r: (r[0] is None, r[0] or 0)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and len(got) == 6


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if i < 4:
            assert docs.columns == columns and 0 < sizes[-1] <= sizes[-2]
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > sizes[4]
    assert docs.where("mix_copy > mix_copies").isEmpty()


def test_copy_of_the_texts_is_packed(spark, monkeypatch):
    import corpus_pipeline
    import pyarrow.parquet as pq
    from pathlib import Path
    stored, store = {}, corpus_pipeline.store
    monkeypatch.setattr(corpus_pipeline, "store", lambda df, name, **more: stored.setdefault(name, store(df, name, **more)))
    corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([(1, "a b c d e f"), (2, "g")], "doc_id long, text string"), SF).collect()
    files = [f.removeprefix("file:").replace("///", "/") for f in stored["pipeline-rows"].inputFiles()]
    parts = [pq.ParquetFile(Path(f)).metadata for f in files]
    found = {m.row_group(0).column(0).compression for m in parts if m.num_row_groups}
    assert found == {"ZSTD"}


def test_scores_do_not_depend_on_the_windows_scored_at_once(monkeypatch):
    """And the keys of the windows scored at once take a megabyte at most."""
    assert lm.BLOCK * lm.SPAN * lm.WIDTH * 4 <= 1 << 20
    rng = np.random.default_rng(5)
    end, sizes = 50, rng.integers(1, 400, 60)
    tokens = rng.integers(0, end, sizes.sum()).astype(np.int16)
    ends = np.cumsum(sizes)
    tokens[ends - 1] = end
    p = lm.new_params(end)
    whole = lm._score(p, tokens, ends, end)
    assert len(whole) == 60 and (whole < 0).all()
    for block in (7, 1 << 20):
        monkeypatch.setattr(lm, "BLOCK", block)
        assert np.allclose(lm._score(p, tokens, ends, end), whole, rtol=1e-5)
