"""Ranking metrics and sweeps against brute force; split, median, folds, scaler."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ledger_spark.operators import metrics as me
from ledger_spark.operators import prep


def _ap(labels, scores):
    pairs = sorted(zip(scores, labels), key=lambda x: -x[0])
    P = sum(labels)
    ap, tp, fp, i = 0.0, 0, 0, 0
    while i < len(pairs):
        s = pairs[i][0]
        dtp = dfp = 0
        while i < len(pairs) and pairs[i][0] == s:
            dtp += pairs[i][1]
            dfp += 1 - pairs[i][1]
            i += 1
        tp, fp = tp + dtp, fp + dfp
        ap += dtp / P * tp / (tp + fp)
    return ap


def _auc(labels, scores):
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10_000))
def test_ranking_metrics_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [("a" if i % 3 else "b", rng.randint(0, 1), round(rng.choice([0.1, 0.25, 0.5, rng.random()]), 3))
            for i in range(120)]
    df = spark.createDataFrame(rows, "g string, label int, score double")
    got = {r.g: r for r in me.ranking_metrics(df, ["g"]).collect()}
    for g in ("a", "b"):
        ys = [y for gg, y, _ in rows if gg == g]
        ss = [s for gg, _, s in rows if gg == g]
        if 0 < sum(ys) < len(ys):
            assert got[g].pr_auc == pytest.approx(_ap(ys, ss), abs=1e-12)
            assert got[g].roc_auc == pytest.approx(_auc(ys, ss), abs=1e-12)


def test_threshold_sweep_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"P{rng.randint(0, 30)}", rng.randint(0, 1), rng.random()) for _ in range(200)]
    df = spark.createDataFrame(rows, "patient_id string, label int, score double")
    got = {round(r.threshold, 2): r for r in me.threshold_sweep(df, []).collect()}
    for t in me.THRESHOLD_GRID:
        flagged = [(p, y) for p, y, s in rows if s >= t]
        r = got[round(t, 2)]
        assert r.true_positives == sum(y for _, y in flagged)
        assert r.flagged_observations == len(flagged)
        assert r.flagged_unique_patients == len({p for p, _ in flagged})


def test_confusion_and_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "label int, score double")
    r = me.confusion(df.withColumn("k", F.lit(1)), ["k"]).first()
    assert (r.true_negatives, r.false_positives, r.precision, r.recall, r.f1) == (2, 0, 0.0, 0.0, 0.0)


def test_matched_recall_prefers_lowest_threshold_on_ties(spark):
    rows = [("A", 0.35, 0.5), ("B", 0.2, 0.4), ("B", 0.25, 0.6), ("B", 0.3, 0.6)]
    sweep = spark.createDataFrame(rows, "model_name string, threshold double, recall double") \
        .select("*", *[F.lit(0).alias(c) for c in ("precision", "f1", "false_positives", "false_negatives",
                                                   "flagged_observations", "flagged_percentage")])
    out = {r.model_name: r for r in me.matched_recall(sweep, "A", "B", [0.35]).collect()}
    assert out["B"].threshold == 0.2


BOUNDS = prep.SplitBounds(dt.date(2026, 2, 1), dt.date(2026, 3, 31), dt.date(2026, 4, 1))


def test_split_borders(spark):
    days = ["2026-01-31", "2026-02-01", "2026-03-31", "2026-04-01"]
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "observation_date date")
    got = [r[0] for r in df.select(prep.split_column(BOUNDS)).collect()]
    assert got == ["train", "validation", "validation", "test"]


def test_train_median_and_indicator(spark):
    df = spark.createDataFrame([("train", 2.0), ("train", None), ("train", 6.0), ("test", 100.0)],
                               "split string, std_previous_refill_interval_days double")
    assert prep.train_median(df).first()[0] == 4.0
    model = prep.TrainMedianImputer().fit(df.filter("split = 'train'"))
    out = model.transform(df.filter("split = 'train'")).collect()
    assert [r.refill_interval_std_available for r in out] == [1, 0, 1]
    assert [r.std_previous_refill_interval_days for r in out] == [2.0, 4.0, 6.0]


def test_time_folds_match_expanding_split(spark):
    n = 47
    rows = [(dt.date(2025, 1, 1) + dt.timedelta(days=i // 3), f"o{i:03d}") for i in range(n)]
    tf = prep.time_folds(spark.createDataFrame(rows, "observation_date date, observation_id string"))
    got = {r.observation_id: (r.position, r.validation_fold) for r in tf.collect()}
    size = n // 6
    for pos, (_, oid) in enumerate(sorted(rows)):
        expected = 0
        for k in range(1, 6):
            start = n - (6 - k) * size
            if start <= pos < start + size:
                expected = k
        assert got[oid] == (pos, expected)


def test_standardization_uses_population_std(spark):
    df = spark.createDataFrame([("train", 1.0), ("train", 3.0)], "split string, x double")
    s = prep.standardization_stats(df, ["x"]).first()
    assert (s.mean, s.std) == (2.0, 1.0)


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10_000))
def test_exact_quantiles_match_numpy(spark, seed):
    import numpy as np
    from ledger_spark.operators.quantiles import exact_quantiles
    rng = random.Random(seed)
    rows = [(rng.choice("xyz"), rng.choice([None, float(rng.randint(-5, 5)), rng.random() * 100]))
            for _ in range(150)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"q10": 0.1, "q25": 0.25, "median": 0.5, "q90": 0.9}
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", probs, count_name="n").collect()}
    for g in "xyz":
        vals = [v for gg, v in rows if gg == g and v is not None]
        if not vals:
            continue
        assert got[g].n == len(vals)
        for name, q in probs.items():
            assert got[g][name] == pytest.approx(float(np.percentile(vals, q * 100)), abs=1e-9)
    empty = exact_quantiles(df.filter("v > 1e9"), [], "v", {"m": 0.5}).collect()
    assert len(empty) == 1 and empty[0].m is None
