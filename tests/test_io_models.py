"""Writers, run ledger, model contract, a small fit, and the driver entry points."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledger_spark.operators import ledger as lg
from ledger_spark.operators import models as mo
from ledger_spark.operators.features import FEATURE_COLUMNS
from ledger_spark.sources import sinks


def test_report_and_workflow_writers(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2026, 7, 1), 1.0 / 3, "x")], "d date, v double, s string")
    sinks.write_report_csv(df, str(tmp_path / "r"))
    back = spark.read.option("header", True).csv(str(tmp_path / "r")).first()
    assert back.d == "2026-07-01" and back.v == "0.33333333"
    sinks.write_longitudinal({"t": df}, str(tmp_path / "long"), summary=df.select("s"), fmt="csv")
    assert spark.read.json(str(tmp_path / "long" / "integrity_summary")).count() == 1
    cases = spark.createDataFrame([("c1", "open"), ("c2", "resolved")], "case_id string, status string")
    sinks.write_workflow_tables(df, cases, df, df, str(tmp_path / "wf"))
    assert spark.read.parquet(str(tmp_path / "wf" / "follow_up_cases")).filter("status = 'open'").count() == 1


def _train(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = {c: rng.random() * 10 for c in FEATURE_COLUMNS}
        if i % 5 == 0:
            x["std_previous_refill_interval_days"] = None
        y = 1.0 if x["previous_on_time_fill_rate"] + rng.random() * 4 > 7 else 0.0
        rows.append((f"P{i % 40}", *[x[c] for c in FEATURE_COLUMNS], y))
    schema = "patient_id string, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS) + ", label double"
    return spark.createDataFrame(rows, schema)


def test_logistic_fit_contract_and_save(spark, tmp_path):
    train = _train(spark)
    model = mo.fit(mo.TUNED_SPECS[0], train)
    lg.check_model_contract(model)
    coef = mo.coefficient_table(model)
    top = coef.orderBy(F.col("absolute_coefficient").desc()).first()
    assert top.feature == "previous_on_time_fill_rate" and top.direction == "positive"
    odds = {r.feature: r for r in mo.odds_ratios(coef).collect()}
    assert odds[top.feature].direction == "increases predicted renewal odds"
    scored = mo.score(model, train)
    assert scored.filter((F.col("score") < 0) | (F.col("score") > 1)).count() == 0
    lg.save_locked_model(model, str(tmp_path / "locked"))
    from pyspark.ml import PipelineModel
    again = PipelineModel.load(str(tmp_path / "locked" / "pipeline"))
    a = mo.score(again, train).agg(F.sum("score")).first()[0]
    b = scored.agg(F.sum("score")).first()[0]
    assert a == pytest.approx(b)


def test_tree_importance_ranks(spark):
    train = _train(spark, 200)
    rf = mo.fit(mo.ModelSpec("Random Forest", "random_forest", {"n_estimators": 10, "max_depth": 4}), train)
    imp = mo.tree_importance(rf)
    assert imp.count() == 16 and imp.filter("rank = 1").count() == 1


def test_ledger_tags_and_locked_lookup(spark):
    runs = spark.createDataFrame([
        ("r1", "candidate", {"run_stage": "baseline"}),
        ("r2", "locked_final", {"run_stage": "final", "test_consumed": "true"}),
        ("r3", "candidate", {"run_stage": "tuned", "patient_id": "x"}),
    ], "run_id string, status string, tags map<string,string>")
    assert [r.run_id for r in lg.tag_policy_violations(runs).collect()] == ["r3"]
    assert lg.locked_run(runs) == "r2"
    with pytest.raises(RuntimeError):
        lg.locked_run(runs.filter("run_id != 'r2'"))


def test_metric_flattening(spark):
    rows = spark.createDataFrame([("r1", "validation", 0.5, 3)], "run_id string, split string, pr_auc double, "
                                                                 "true_positives long")
    rows = rows.select("*", *[F.lit(0.0).alias(c) for c in lg.METRIC_COLUMNS if c not in rows.columns])
    keys = {r.key: r.value for r in lg.flatten_metrics(rows).collect()}
    assert keys["validation_pr_auc"] == 0.5 and keys["validation_tp"] == 3.0


def test_entry_contract(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0 and "status" in df.columns
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 70


def test_draws_are_distinct_in_every_family():
    for family, trials in mo.SEARCH_TRIALS.items():
        draws = [tuple(sorted(d.items(), key=str)) for d in mo.sample_params(family, trials)]
        assert len(set(draws)) == len(draws) == trials
    assert len(mo.sample_params("logistic_regression", 99)) == 14


def test_tuning_refits_the_best_trial_of_each_family(spark, monkeypatch):
    from ledger_spark.operators import prep
    rows = [(*r, "validation" if i % 4 == 3 else "train", i, int(i >= 100))
            for i, r in enumerate(_train(spark, 200).collect())]
    data = spark.createDataFrame(rows, "patient_id string, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS)
                                 + ", label double, split string, position long, validation_fold int")
    monkeypatch.setitem(mo.SEARCH_GRIDS, "random_forest", {"n_estimators": [2], "max_depth": [2, 3]})
    monkeypatch.setitem(mo.SEARCH_GRIDS, "logistic_regression", {"C": [0.01, 1], "penalty": ["l2"]})
    folds, trials, found = data.filter("split = 'train'"), {"random_forest": 2, "logistic_regression": 2}, []
    search = mo._search
    monkeypatch.setattr(mo, "_search", lambda *a: found.append(search(*a)) or found[-1])
    got = mo.tune_models(data, folds, trials, features=prep.REDUCED_FEATURE_COLUMNS).collect()
    names = ("Logistic Regression", "Random Forest")
    assert sorted((r.model_name, r.split) for r in got) == [(m, s) for m in names for s in ("train", "validation")]
    for name, results in zip(names, found):
        best, ap = max(results, key=lambda r: r[1])
        assert len(results) == 2 and {(r.trials, r.best_cv_pr_auc, r.best_parameters) for r in got if r.model_name == name} == {
            (2, ap, str(sorted(best.items())))}


def test_confusion_contract(spark):
    from ledger_spark.operators import metrics as me
    df = spark.createDataFrame([(1.0, 0.9), (0.0, 0.1), (0.0, 0.2)], "label double, score double")
    assert me.confusion_contract(df, {"TN": 2, "TP": 1}) == {"TN": 2, "FP": 0, "FN": 0, "TP": 1}
    assert me.confusion_contract(df.limit(0), {}) == dict.fromkeys(me.OUTCOMES, 0)
    with pytest.raises(ValueError, match="TN.*3, 2"):
        me.confusion_contract(df, {"TN": 3})
