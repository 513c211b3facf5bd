"""Operators with an exact answer, against brute force on small rows with every awkward case."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledger_spark.llm import chat, components, decontaminate, jaccard_join, line_dedup, mixing, substring_dedup, topk
from ledger_spark.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, cls string"


def docs_of(spark, texts, ids=None):
    """Rows whose extra columns clash with names that the operators use inside."""
    rows = [(i if ids is None else ids[i], t, "en", ["b", "a", None][i % 3], 0, 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def corpus(seed=1, n=60):
    """Copies, near copies, shared passages, null, empty, blank and long texts, repeated words and lines."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "IT", "it"]
    passage = " ".join(rng.choice(words) for _ in range(30))
    line = "A Line that many documents share"
    out = [None, "", "  \n\t ", "one", "one two", "long " * 3000]
    while len(out) < n:
        kind = rng.random()
        text = " ".join(rng.choice(words) for _ in range(rng.choice([2, 30, 60])))
        if kind < 0.2 and len(out) > 10:
            text = out[rng.randrange(6, len(out))]
        elif kind < 0.45 and len(out) > 10:
            parts = out[rng.randrange(6, len(out))].split(" ")
            parts[rng.randrange(len(parts))] = "edited"
            text = " ".join(parts)
        elif kind < 0.6:
            text = f"{text}\n{passage}  {text}"
        elif kind < 0.8:
            text = f"{text}\n \t{rng.choice([line, line.lower(), line.upper()])} \n\n{line}"
        out.append(text)
    return out


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard_components(spark, k, percent):
    texts = corpus(2, 80)
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           jaccard_join.near_duplicates(docs_of(spark, texts), k, percent, frequent=50).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_jaccard_empty_and_repeated_rows(spark):
    assert jaccard_join.near_duplicates(docs_of(spark, [])).count() == 0
    rows = docs_of(spark, ["a b c d e f", "a b c d e f", None], ids=[4, 4, None])
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard_join.near_duplicates(rows).collect())
    assert got == [(0, 0, 0), (4, 2, 4), (4, 2, 4)]


def test_matches_needs_no_more_than_the_overlap():
    import numpy as np
    assert jaccard_join.matches(np.ones(1), 1, 90) == 1
    assert 1 <= jaccard_join.matches(np.full(100, 5000), 100, 90) <= jaccard_join.MOST_MATCHES


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 120)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 120)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("chunk_bytes", [1 << 23, 1500])
def test_substrings(spark, chunk_bytes):
    texts = corpus(3)
    first, gone = {}, collections.defaultdict(set)
    words = [(t or "").encode().split() for t in texts]
    for i, w in enumerate(words):
        for s in range(len(w) - 19):
            if first.setdefault(tuple(w[s:s + 20]), (i, s)) != (i, s):
                gone[i].update(range(s, s + 20))
    want = {i: (len(w), len(gone[i]), b" ".join(x for p, x in enumerate(w) if p not in gone[i]).decode()) for i, w in enumerate(words)}
    rows = substring_dedup.dedup_substrings(docs_of(spark, texts), chunk_bytes=chunk_bytes).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in rows} == want
    assert substring_dedup.dedup_substrings(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("batches,fanout,broadcast_keys", [(1, 4, 100), (5, 2, 100), (None, 2, 0)])
def test_lines(spark, batches, fanout, broadcast_keys):
    texts = corpus(4)
    blanks = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(blanks).translate(lower)
    lines = [(t or "").split("\n") for t in texts]
    held = collections.defaultdict(set)
    for i, some in enumerate(lines):
        for x in some:
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    want = {i: "\n".join(x for x in some if not (len(held[key(x)]) >= 3 and i < max(held[key(x)]))) for i, some in enumerate(lines)}
    docs = docs_of(spark, texts)
    out = line_dedup.dedup_lines(docs, batches=batches, fanout=fanout, counts=True, broadcast_keys=broadcast_keys)
    assert out.columns == docs.columns + ["n_lines", "n_dropped"]
    assert {r.doc_id: r.text or "" for r in out.collect()} == want
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0


def test_line_runs_are_compacted_before_the_last_batch_and_join_without_an_exchange(spark):
    docs = docs_of(spark, corpus(4, 120))
    with Scratch(spark, "test") as scratch:
        runs = line_dedup.settled_keys(docs, scratch)
        assert runs.compactions >= 2 and len(runs.levels) >= 2
        few = scratch.bucketed(runs._runs()[0].repartition(runs.buckets, "h1", "h2"), runs.buckets, ["h1", "h2"], ["h1", "h2"])
        assert len(runs._runs()) > 1
        for plan in (runs.unsettled(few), runs._merged(runs._runs()[:2])):
            text = plan._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in text
        assert "SortMergeJoin" in runs.unsettled(few)._jdf.queryExecution().executedPlan().toString()
        # the first batch holds the largest ids: its keys are settled there, and no later run holds them again
        first = max(runs._runs(), key=lambda run: run.agg(F.max("keeper")).first()[0])
        settled = first.where("docs >= 3").select("h1", "h2")
        assert all(not other.join(settled, ["h1", "h2"]).count() for other in runs._runs() if other is not first)
        every = line_dedup._exploded(docs, "doc_id", "text", 20).groupBy("h1", "h2").agg(
            F.count("*").alias("docs"), F.max("doc").alias("keeper")).where("docs >= 3").select("h1", "h2", "keeper")
        assert sorted(map(tuple, runs.settled().collect())) == sorted(map(tuple, every.collect())) != []
        folder, name = scratch.folder, scratch.tables[0]
    assert not spark.catalog.tableExists(name)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


def test_lines_of_one_document_in_two_rows_count_once(spark):
    rows = docs_of(spark, ["a line of twenty characters"] * 3, ids=[1, 1, 2])
    assert all(r.text for r in line_dedup.dedup_lines(rows).collect())


def benchmark(spark):
    text = "Seven Words, then some more: up to twelve words in all É"
    return spark.createDataFrame([(1, text), (2, "short item"), (3, None), (4, "..."), (1, text), (None, "lost and found")],
                                 "item_id long, text string")


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_LIMIT, 1])
def test_decontamination(spark, limit):
    texts = ["xx seven WORDS then some-more up to twelve words in all É yy", "a short, item here", "short  x item", None, "",
             "seven words then some more up to twelve words", "lost and found", "SHORT item short item"]
    bench = decontaminate.benchmark_windows(benchmark(spark), broadcast_limit=limit)
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontaminate.find_hits(docs_of(spark, texts), bench).collect()}
    assert got == {0: (14, 12, ["1"]), 1: (4, 2, ["2"]), 2: (3, 0, []), 3: (0, 0, []), 4: (0, 0, []), 5: (9, 0, []),
                   6: (3, 3, [""]), 7: (4, 4, ["2"])}
    kept = decontaminate.remove_contaminated(docs_of(spark, texts), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]
    assert kept.columns == docs_of(spark, texts).columns


def test_decontamination_of_spans(spark):
    bench = decontaminate.benchmark_windows(benchmark(spark))
    out = decontaminate.remove_contaminated(docs_of(spark, ["A short, item here.", None, "clean, TEXT!"]), bench, "spans")
    assert {r.doc_id: r.text for r in out.collect()} == {0: "A here.", 1: None, 2: "clean, TEXT!"}


def test_decontamination_of_spans_beyond_the_limit(spark):
    bench = decontaminate.benchmark_windows(benchmark(spark), broadcast_limit=0)
    docs = docs_of(spark, ["A short, item here.", None, "clean, TEXT!"])
    out = decontaminate.remove_contaminated(docs.union(docs), bench, "spans")
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.text) == [(0, "A here.")] * 2 + [(2, "clean, TEXT!")] * 2
    assert out.where("text IS NULL").count() == 2


def test_top_k(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], 0) for i in range(300)]
    rows += [(i, rows[20][1], 1) for i in range(300, 400)]            # one very common vector
    rows += [(400, None, 0), (420, [None, 1.0], 0), (440, [float("nan")] * 6, 0), (None, [1.0] * 6, 0), (7, rows[7][1], 0)]
    code = {i: [int((64 * x) // 1) for x in v] for i, v, _ in rows if i is not None and v and None not in v and v[0] == v[0]}
    want = set()
    for q in (i for i in code if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(code[q], c)), i) for i, c in code.items() if i != q)[:20]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)}
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(3)
    assert {tuple(r) for r in topk.top_k(vectors).collect()} == want
    assert topk.top_k(vectors.where("vec_id < 0")).count() == 0
    assert topk.top_k(vectors.where("vec_id in (0, 3)")).count() == 1


def test_mixing(spark):
    texts = [None, ""] + [" ".join("w" for _ in range(1 + (i * 37) % 90)) for i in range(400)]
    docs = docs_of(spark, texts).withColumn("weight", F.col("doc_id") % 3).coalesce(2)
    for weight in (None, "weight"):
        rows = mixing.plan_mix(docs, weight_col=weight).collect()
        again = mixing.plan_mix(docs, weight_col=weight).collect()
        assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == len(texts)
        taken, target = collections.Counter(), {}
        for r in rows:
            assert r._mx_copies in (0, 1, 2) and r._mx_size == len((texts[r._mx_id] or "").split())
            key = r._mx_id % 3
            taken[key] += r._mx_copies * r._mx_size
            target[key] = r._mx_target
        total = sum(len((t or "").split()) for t in texts)
        assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total
        if weight is None:
            assert all(abs(taken[k] - target[k]) <= 2 for k in target)
    assert mixing.plan_mix(docs_of(spark, [])).count() == 0


def test_mix_takes_documents_as_often_as_their_odds_say(spark):
    texts = [" ".join(["w"] * (3, 12, 48)[i // 3 % 3]) for i in range(2700)]
    rows = mixing.plan_mix(docs_of(spark, texts).coalesce(2), share=0.9).collect()
    classes = collections.defaultdict(list)
    for r in rows:
        classes[r._mx_id % 3, r._mx_size].append(r)
    for source in range(3):
        mine = [(size, classes[source, size]) for size in (3, 12, 48)]
        expected = [some[0]._mx_expected for _, some in mine]
        assert expected == sorted(expected) and abs(expected[0] * 3 - expected[2]) < 1e-9 or expected[2] == 2
        target = mine[0][1][0]._mx_target
        assert abs(sum(size * r._mx_expected for size, some in mine for r in some) - target) < 1e-6 * target
        for x, (_, some) in zip(expected, mine):
            assert abs(sum(r._mx_copies for r in some) / len(some) - x) < 0.1
            assert {r._mx_copies for r in some} <= {int(x), int(x) + 1}


def test_mix_weights_share_what_the_cap_leaves(spark):
    rows = spark.createDataFrame([("a", 9.0, 100), ("a", 1.0, 300), ("a", 0.0, 50), ("b", 4.0, 10)],
                                 "_mx_source string, _mx_weight double, _mx_size long")
    targets = spark.createDataFrame([("a", 450, 350.0), ("b", 10, 20.0)], "_mx_source string, _mx_source_size long, _mx_target double")
    got = {(r._mx_source, r._mx_weight): r._mx_expected for r in mixing.expected_copies(rows, targets).collect()}
    assert got == {("a", 9.0): 2.0, ("a", 1.0): 0.5, ("a", 0.0): 0.0, ("b", 4.0): 2.0}
    steps = spark.createDataFrame([(None,), (float("nan"),), (-1.0,), (0.0,), (8.0,), (8.5,), (1e300,)], "w double")
    assert [r[0] for r in steps.select(mixing.stepped(F.col("w"))).collect()] == [0, 0, 0, 0, 8, 8, 2.0 ** 64]


def test_mix_repeats_documents(spark):
    docs = docs_of(spark, ["a b c", "d e", "f"] * 20).coalesce(1)
    plan = {r._mx_id: r._mx_copies for r in mixing.plan_mix(docs).collect()}
    out = mixing.mix_documents(docs).collect()
    assert collections.Counter(r.doc_id for r in out) == {k: v for k, v in plan.items() if v}


def test_targets_stop_at_twice_the_size(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "_mx_source string, _mx_size long")
    got = {r._mx_source: r._mx_target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 20 and got[None] == 0 and abs(sum(got.values()) - 3015) < 1e-6 and got["c"] == 2 * got["b"] or got["c"] <= 2000


def test_chat(spark):
    nasty = "\\</s>[INST] \\\\ ok [/INST] É <<SYS>>[/TURN]\\"
    rows = [(1, 0, "system", nasty, 0), (1, 1, "user", None, 0), (1, 2, "assistant", nasty, 0), (1, 3, "user", "x", 0),
            (2, 0, "tool [ROLE]", "y", 0), (2, 1, None, "", 0), (2, 1, None, "", 0), (None, 5, "assistant", "z\n", 0)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss int")
    formatted = chat.segments(table)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for conv in (1, 2, None):
        mine = sorted(((t, r or "", x or "") for c, t, r, x, _ in rows if c == conv))
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert got[conv].n_turns == len(mine)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [got[c].valid for c in (1, 2, None)] == [True, False, False]
    assert sum(len(r.text) for r in formatted.where("conv_id = 1").collect()) == got[1].formatted_chars
    assert chat.read_back(chat.segments(table.where("conv_id > 5"))).count() == 0
