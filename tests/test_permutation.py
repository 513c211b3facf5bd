"""Permutation importance against a plain-Python shuffle by the same hash orders, and the size of its plan."""

import random
import statistics

from pyspark.sql import functions as F

from ledger_spark.operators import models as mo
from ledger_spark.operators.features import FEATURE_COLUMNS


def rows_of(spark, n=120, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.random() * 10 for _ in FEATURE_COLUMNS]
        if i % 4 == 0:
            x[FEATURE_COLUMNS.index("std_previous_refill_interval_days")] = None
        rows.append((f"O{i:04d}", *x, float(x[3] + rng.random() * 6 > 8)))
    return spark.createDataFrame(rows, "observation_id string, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS) + ", label double")


def average_precision(pairs):
    positives, seen, hits, total = sum(y for _, y in pairs), 0, 0, 0.0
    for score in sorted({s for s, _ in pairs}, reverse=True):
        here = [y for s, y in pairs if s == score]
        seen, hits = seen + len(here), hits + sum(here)
        total += sum(here) / positives * hits / seen
    return total


def test_importance_is_that_of_shuffled_rows(spark):
    data = rows_of(spark)
    model = mo.fit(mo.TUNED_SPECS[0], data)
    features, repeats = (FEATURE_COLUMNS[3], "std_previous_refill_interval_days"), 2
    got = {r.feature: r for r in mo.permutation_importance(model, data, repeats, features).collect()}
    keyed = data.withColumn("rid", F.xxhash64(*[F.col(c) for c in data.columns]))
    base = average_precision([(r.score, r.label) for r in mo.score(model, data).collect()])
    for f in features:
        drops = []
        for r in range(repeats):
            held = keyed.withColumn("kb", F.xxhash64("rid", F.lit(f), F.lit(r), F.lit(mo.SEED))).collect()
            donors = [row[f] for row in sorted(held, key=lambda row: row.kb)]
            rows = [row.asDict() | {f: d} for row, d in zip(sorted(held, key=lambda row: row.rid), donors)]
            copy = spark.createDataFrame([tuple(row[c] for c in data.columns) for row in rows], data.schema)
            drops.append(base - average_precision([(x.score, x.label) for x in mo.score(model, copy).collect()]))
        assert abs(got[f].mean_importance - statistics.mean(drops)) < 1e-9
        assert abs(got[f].standard_deviation - statistics.pstdev(drops)) < 1e-9
    assert sorted(r.rank for r in got.values()) == [1, 2]


def nodes(plan):
    found = [plan]
    children = plan.children()
    for i in range(children.size()):
        found += nodes(children.apply(i))
    return found


def test_copies_are_ranked_without_their_rows(spark):
    data = rows_of(spark, 40)
    found = mo.permutation_importance(mo.fit(mo.TUNED_SPECS[0], data), data, 30)
    plan = found._jdf.queryExecution().optimizedPlan()
    names = {f for f in FEATURE_COLUMNS}
    ranked = [n for n in nodes(plan) if n.nodeName() == "Window" and any(m.nodeName() == "Generate" for m in nodes(n))
              and not any(m.nodeName() == "Join" for m in nodes(n))]
    assert ranked
    for window in ranked:       # the copies: a number and one donor value are ranked, never a row's features
        out = window.output()
        assert not names & {out.apply(i).name() for i in range(out.size())}
