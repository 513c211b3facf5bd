"""Merkle manifest, conversation repair and BPE against plain single-machine versions, with every awkward case."""

import hashlib
import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledger_spark.llm import bpe, merkle, repair

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- Merkle manifest
def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def grow(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at // 8 * 8:at // 8 * 8 + 8]
        out.append(("".join(run[:at % 8]), "".join(run[at % 8 + 1:])))
        at //= 8
    return out


def plain_manifest(rows):
    """{(id, leaf): multiset of (subroot, root, siblings)} by the rule of the trees."""
    keys = sorted({k for _, k, _ in rows}, key=lambda k: (k is not None, (k or "").encode()))
    trees = [grow([leaf for _, leaf in sorted(((i, leaf) for i, key, leaf in rows if key == k),
                                              key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]) for k in keys]
    over = grow([t[-1][0] for t in trees])
    out = []
    for n, (k, tree) in enumerate(zip(keys, trees)):
        mine = sorted(((i, leaf) for i, key, leaf in rows if key == k), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        for at, (i, leaf) in enumerate(mine):
            out.append((str(i), leaf, tree[-1][0], over[-1][0], str(siblings(tree, at) + siblings(over, n))))
    return sorted(out)


def test_manifest_matches_the_plain_trees(spark):
    rng = random.Random(5)
    sizes = {"en": 700, "fr": 9, None: 8, "de": 1, "": 65, "z": 64}
    rows = [(rng.choice([None, *range(400)]), k, H(str(rng.randrange(500)))) for k, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "id long, lang string, leaf string").repartition(5)
    proofs = merkle.prove(merkle.build(df, "lang", "id"))
    got = [(str(r.id), r.leaf, r.subroot, r.root, str(list(zip(r.left, r.right)))) for r in proofs.collect()]
    assert sorted(got) == plain_manifest(rows)
    checked = proofs.select((merkle.fold(F.col("leaf"), F.col("left"), F.col("right")) == F.col("root")).alias("same"),
                            (merkle.fold(F.lit(H("x")), F.col("left"), F.col("right")) == F.col("root")).alias("forged"))
    assert {(r.same, r.forged) for r in checked.collect()} == {(True, False)}


def test_manifest_of_few_or_no_rows_and_refused_names(spark):
    schema = "id long, lang string, leaf string"
    empty = merkle.build(spark.createDataFrame([], schema), "lang", "id")
    assert merkle.prove(empty).count() == 0 and empty.root.count() == 0
    one = merkle.prove(merkle.build(spark.createDataFrame([(None, None, "ab")], schema), "lang", "id")).first()
    assert (one.subroot, one.root, one.left, one.right) == ("ab", "ab", [], [])
    with pytest.raises(ValueError, match="pos"):
        merkle.build(spark.createDataFrame([], "pos long, lang string, leaf string"), "lang", "pos")


def test_leaf_of_null_empty_and_unicode(spark):
    df = spark.createDataFrame([(1, None, ""), (None, "é", "x:1")], "a long, b string, c string")
    got = [r[0] for r in df.select(merkle.leaf([F.col("a"), F.col("b"), F.col("c")])).collect()]
    assert sorted(got) == sorted([H("1:1", "-", "0:"), H("-", "2:é", "3:x:1")])


# ---------------------------------------------------------------- conversation repair
def plain_repair(turns):
    """The audit of one conversation (rows in order) by dynamic programming over whole prefixes."""
    seen, faults = set(), []
    for role, text in turns:
        blank = not text.strip(" \t\n\x0b\x0c\r")
        again = not blank and (role, text) in seen
        cut = not blank and not again and text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?"
        seen.add((role, text))
        faults.append((blank, again, cut))
    best = {0: (0, "", ())}

    def offer(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    def inserted(table):
        for _ in range(2):
            for state, (cost, audit, out) in list(table.items()):
                role, after = ("assistant", 3) if state == 2 else ("user", 2)
                offer(table, after, (cost + 5, audit + "I", (*out, (role, ""))))

    for (role, text), (blank, again, cut) in zip(turns, faults):
        inserted(best)
        after = {}
        for state, (cost, audit, out) in best.items():
            offer(after, state, (cost + 2, audit + "D", out))
            if blank or again:
                continue
            want, to = ("assistant", 3) if state == 2 else ("user", 2)
            offer(after, to, (cost + 1 + 5 * cut, audit + "R", (*out, (want, text))))
            if role[:1] == want[:1]:
                offer(after, to, (cost + 5 * cut, audit + "K", (*out, (role, text))))
            if role[:1] == "s" and state == 0:
                offer(after, 1, (cost + 5 * cut, audit + "K", (*out, (role, text))))
        best = after
    inserted(best)
    cost, audit, out = min(v for s, v in best.items() if s in (0, 3))
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(turns, turns[1:])]
    return (sum(f[0] for f in faults), sum(f[1] for f in faults), sum(f[2] for f in faults),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, H("\n".join(f"{r}:{t}" for r, t in out)))


def test_repair_matches_dynamic_programming(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for conv, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 31, 32, 33, 64, 65, 130, 200] * 3):
        turns = []
        for turn in range(n):
            role = rng.choice(["user", "assistant"] * 3 + ["system", "tool", "", "summary"]) if rng.random() < 0.5 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "no", "", " \n", "Why?", f"line {turn}.", f"cut {turn}", "long " * 50 + "."])
            turns.append((role, text))
        rows += [(conv, turn * 2, role, text) for turn, (role, text) in enumerate(turns)]
        want[conv] = (2 * n - 1 - n, *plain_repair(turns))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    audits, edits = repair.repair(df)
    done = audits.join(repair.digests(edits), "conv_id").collect()
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in done} == want


def test_repair_of_nulls_ties_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string, block long, n string"
    rows = [(None, None, None, None, 1, "x"), (None, 3, "user", "Hi.", 1, "x"), (None, 3, "assistant", "Yo.", 1, "x"),
            (4, None, "user", "A.", 1, "x"), (4, None, "user", "A.", 1, "x")]
    audits, edits = repair.repair(spark.createDataFrame(rows, schema))
    got = {r.conv_id: r for r in audits.collect()}
    # null turn first, then by role: assistant before user
    assert (got[None].gaps, got[None].blank, got[None].illegal, got[None].audit) == (0, 1, 1, "DRR")
    assert (got[4].gaps, got[4].duplicate, got[4].cost, got[4].audit) == (0, 1, 4, "DD")
    assert {r.conv_id for r in repair.digests(edits).collect()} == {None, 4}
    none, nothing = repair.repair(spark.createDataFrame([], schema))
    assert none.count() == 0 and repair.digests(nothing).count() == 0


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{c}:{t}".encode()) % 20
        row = (c, t, "user" if k == 4 else role, "" if k == 1 else "One Two" if k == 2 else text)
        want += [] if k == 0 else [row, row] if k == 3 else [row]
    assert sorted(map(tuple, repair.damage(df).collect())) == sorted(want)


# ---------------------------------------------------------------- BPE
def test_bpe_matches_the_library(spark):
    rng = random.Random(3)
    alphabet = [*"abcABC'019 .,!?\n\t", "é", "ß", "'s", "'ll", "<|endoftext|>", "  ", "　", "中文", "Ж", "՘", "Ⱟ", "🙂", "​",
                "\x1c", "\x85", "\xa0", "²", "\U00011de0"]
    texts = [None, "", " ", "<|endoftext|>", "a" * 5000, "word " * 3000] + ["".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(300)]
    rows = [(i % 200 if i % 7 else None, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk long").repartition(3)
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = []
    for i, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, tokenizer.decode(ids, skip_special_tokens=False)))
    for size in (200, bpe.CHUNK):
        got = [(r.doc_id, list(r.ids), r.decoded) for r in bpe.encode_decode(df, VOCABULARY, chunk_chars=size).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.encode_decode(df.limit(0), VOCABULARY).count() == 0


def test_bpe_plain_characters_split_alike():
    splitter = bpe.Splitter(open(VOCABULARY, encoding="utf-8").read())
    plain = [chr(c) for c in range(0xA000) if not splitter.unusual.search(chr(c))]
    assert len(plain) > 20000
    for probe in "a1!":
        text = "".join(f"{probe}{c}\n" for c in plain)
        assert splitter.words.findall(text) == [text[a:b] for _, (a, b) in splitter.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
