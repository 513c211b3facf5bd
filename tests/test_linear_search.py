"""The stored linear model as a column, its contract and lookup; searches whose trials share fits."""

import random

import duckdb
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledger_spark.operators import ledger as lg
from ledger_spark.operators import linear
from ledger_spark.operators import models as mo
from ledger_spark.operators import scoring as sc
from ledger_spark.operators.features import FEATURE_COLUMNS
from ledger_spark.operators.prep import MODEL_FEATURE_COLUMNS, REDUCED_FEATURE_COLUMNS


def observations(spark, n=300, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.random() * 10 for _ in FEATURE_COLUMNS]
        if i % 4 == 0:
            x[FEATURE_COLUMNS.index("std_previous_refill_interval_days")] = None
        rows.append((f"O{i:04d}", *x, float(x[3] + rng.random() * 6 > 8)))
    return spark.createDataFrame(rows, "observation_id string, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS) + ", label double")


@pytest.fixture(scope="module")
def fitted(spark):
    data = observations(spark)
    return data, mo.fit(mo.TUNED_SPECS[0], data)


def test_compiled_column_and_sql_are_the_pipeline(spark, fitted):
    data, model = fitted
    compiled = linear.from_pipeline(model)
    both = mo.score(model, data.withColumn("compiled", compiled.column()))
    assert both.agg(F.max(F.abs(F.col("score") - F.col("compiled")))).first()[0] < 1e-12
    frame = both.toPandas()
    con = duckdb.connect()
    con.register("rows", frame)
    assert con.sql(f"SELECT max(abs(score - {compiled.sql()})) FROM rows").fetchall()[0][0] < 1e-12
    assert linear.from_table(compiled.table(spark)) == compiled
    missing = data.select(*[F.lit(None).cast("double").alias(c) if c == "previous_fill_count" else c for c in data.columns])
    assert missing.where(compiled.column().isNotNull()).count() == 0


def test_other_models_are_refused(spark, fitted):
    data, model = fitted
    forest = mo.fit(mo.ModelSpec("Random Forest", "random_forest", {"n_estimators": 2, "max_depth": 2}), data)
    with pytest.raises(linear.ModelContractError, match="Stages"):
        linear.from_pipeline(forest)
    with pytest.raises(linear.ModelContractError, match="order"):
        linear.from_pipeline(model, tuple(reversed(MODEL_FEATURE_COLUMNS)))
    with pytest.raises(linear.ModelContractError, match="order"):
        linear.from_pipeline(mo.fit(mo.TUNED_SPECS[0], data, REDUCED_FEATURE_COLUMNS))
    stored = linear.from_pipeline(model).table(spark)
    for broken in (stored.where("position < 15"), stored.withColumn("position", 15 - F.col("position")),
                   stored.withColumn("scale", F.lit(0.0)), stored.withColumn("weight", F.lit(float("nan"))),
                   stored.withColumn("impute", F.lit(None).cast("double")),
                   stored.withColumn("intercept", F.col("position").cast("double"))):
        with pytest.raises(linear.ModelContractError):
            linear.from_table(broken)
    with pytest.raises(linear.ModelContractError, match="penalty"):
        lg.check_model_contract(model, train_rows=data.count() + 1)
    with pytest.raises(linear.ModelContractError, match="L2"):
        lg.check_model_contract(mo.fit(mo.ModelSpec("L", "logistic_regression", {"C": 0.01, "penalty": "l1"}), data))
    with pytest.raises(linear.ModelContractError, match="Iterations"):
        lg.check_model_contract(mo.fit(mo.ModelSpec("L", "logistic_regression", {"C": 0.01, "max_iter": 5}), data))


def test_locked_lookup_takes_one_run_and_one_artifact(spark, fitted, tmp_path):
    data, model = fitted
    path = str(tmp_path / "locked")
    lg.save_locked_model(model, path, train_rows=data.count())
    tags = "run_id string, status string, tags map<string,string>"
    runs = spark.createDataFrame([("r1", "candidate", {}), ("r2", "locked_final", {"test_consumed": "true"})], tags)
    artifacts = spark.createDataFrame([("r2", path), ("r1", "elsewhere")], "run_id string, path string")
    assert lg.load_locked_model(runs, artifacts) == linear.from_pipeline(PipelineModel.load(f"{path}/pipeline"))
    for wrong in (artifacts.where("run_id = 'r1'"), artifacts.union(artifacts)):
        with pytest.raises(RuntimeError, match="artifacts"):
            lg.load_locked_model(runs, wrong)
    spark.read.parquet(f"{path}/terms").withColumn("weight", F.col("weight") + 1).coalesce(1).write.parquet(f"{path}/other")
    changed = spark.read.parquet(f"{path}/other").collect()
    spark.createDataFrame(changed, linear.TABLE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/terms")
    with pytest.raises(linear.ModelContractError, match="terms"):
        lg.load_locked_model(runs, artifacts)


def test_recorded_coefficients_and_differences(spark):
    rows = observations(spark).withColumn("split", F.when(F.col("observation_id") < "O0200", "train").otherwise("test"))
    stored = linear.from_table(linear.from_recorded(rows))
    assert linear.coefficient_differences(stored) == {}
    train = rows.where("split = 'train'").toPandas()
    median = train["std_previous_refill_interval_days"].median()
    assert {t.feature: t.impute for t in stored.terms if t.impute is not None} == {"std_previous_refill_interval_days": pytest.approx(median)}
    age = next(t for t in stored.terms if t.feature == "prescription_age_days")
    assert (age.mean, age.scale) == (pytest.approx(train[age.feature].mean()), pytest.approx(train[age.feature].std(ddof=0)))
    other = dict(linear.RECORDED_COEFFICIENTS, prescription_age_days=-0.0002, extra=1.0)
    assert set(linear.coefficient_differences(stored, other)) == {"prescription_age_days", "extra"}


def test_unknown_request_fields_are_refused(spark):
    fields = ", ".join(f"{n} {'string' if k == 'str' else 'date' if k == 'date' else 'double'}" for n, k, *_ in sc.REQUEST_FIELDS)
    good = spark.createDataFrame([], fields)
    assert sc.score_batch(good, F.current_date(), lambda: F.lit(0.9)).count() == 0
    with pytest.raises(ValueError, match="patient_name"):
        sc.score_batch(good.withColumn("patient_name", F.lit("x")), F.current_date(), lambda: F.lit(0.9))


def test_first_trees_are_the_shorter_fit(spark, fitted):
    data, _ = fitted
    folds = data.select("*", F.row_number().over(Window.orderBy("observation_id")).alias("p")).select(
        "*", (F.col("p") - 1).alias("position"), F.when(F.col("p") > 200, 1).otherwise(0).alias("validation_fold"))
    fold, = mo.prepared_folds(folds, False, MODEL_FEATURE_COLUMNS)
    assert (fold.fit_rows, fold.held_out.count()) == (200, 100)
    boosted = {"max_depth": 2, "learning_rate": 0.1, "subsample": 1.0}
    fits = [mo._classifier(mo.ModelSpec("B", "gbt_depthwise", dict(boosted, n_estimators=n)), 200).fit(fold.fit) for n in (3, 8)]
    cut = mo.first_trees(fits[1], 3)
    margins = [[r[0][1] for r in m.transform(fold.held_out).select("probability").collect()] for m in (fits[0], cut)]
    assert len(cut.trees) == 3 and margins[0] == pytest.approx(margins[1])
    assert mo.first_trees(fits[1], 8) is fits[1]
    forest = mo._classifier(mo.ModelSpec("F", "random_forest", {"n_estimators": 6, "max_depth": 3}), 200).fit(fold.fit)
    few = mo.first_trees(forest, 2)
    assert [t.toDebugString for t in few.trees] == [t.toDebugString for t in forest.trees[:2]]
    assert few.transform(fold.held_out).count() == 100


def test_trials_that_differ_in_rounds_share_a_fit(spark, fitted, monkeypatch):
    data, _ = fitted
    folds = data.selectExpr("*", "CAST(substr(observation_id, 2) AS LONG) AS position",
                            "CASE WHEN observation_id >= 'O0200' THEN 2 WHEN observation_id >= 'O0100' THEN 1 ELSE 0 END AS validation_fold")
    monkeypatch.setitem(mo.SEARCH_GRIDS, "gbt_depthwise", {"n_estimators": [2, 4], "learning_rate": [0.1, 0.3], "max_depth": [2], "subsample": [1.0]})
    made = []
    classifier = mo._classifier
    monkeypatch.setattr(mo, "_classifier", lambda spec, n: made.append(spec) or classifier(spec, n))
    shared = mo._search("gbt_depthwise", "B", folds, 4, 2, MODEL_FEATURE_COLUMNS)
    assert len(shared) == 4 and len(made) == 2 * 2          # two learning rates on two folds, not four trials
    for params, ap in shared:
        aps = []
        for k in (1, 2):
            model = mo.fit(mo.ModelSpec("B", "gbt_depthwise", params), folds.where(F.col("position") < 100 * k))
            aps.append(mo.me.ranking_metrics(mo.score(model, folds.where(F.col("validation_fold") == k)), []).first()["pr_auc"])
        assert ap == pytest.approx(sum(aps) / 2)


def test_settings_do_not_change_a_fit(spark, fitted):
    data, _ = fitted
    spec = mo.ModelSpec("F", "random_forest", {"n_estimators": 3, "max_depth": 3})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for n in ("2", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(mo.fit(spec, data).stages[-1].toDebugString.split("\n", 1)[1])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_linear_fits_have_fewer_partitions_than_tree_fits(spark, monkeypatch):
    data = observations(spark, 300)
    monkeypatch.setattr(mo, "FIT_PARTITION_ROWS", 20)
    monkeypatch.setattr(mo, "LINEAR_PARTITION_ROWS", 100)
    assert mo._dealt(data, 300, MODEL_FEATURE_COLUMNS, True).rdd.getNumPartitions() == 3
    assert mo._dealt(data, 300, MODEL_FEATURE_COLUMNS, False).rdd.getNumPartitions() == 15
    folds = data.withColumn("position", F.row_number().over(Window.orderBy("observation_id")) - 1)
    folds = folds.withColumn("validation_fold", F.floor(F.col("position") / 100).cast("int"))
    linear = mo.prepared_folds(folds, True, MODEL_FEATURE_COLUMNS)
    assert [f.fit.rdd.getNumPartitions() for f in linear] == [1, 2]
    many = mo.fit(mo.TUNED_SPECS[0], data).stages[-1]
    monkeypatch.setattr(mo, "LINEAR_PARTITION_ROWS", 10)
    one = mo.fit(mo.TUNED_SPECS[0], data).stages[-1]
    assert max(abs(a - b) for a, b in zip(many.coefficients, one.coefficients)) < 1e-6


def test_boosted_fits_keep_no_node_cache_and_grow_the_same_trees(spark):
    from pyspark.ml.feature import VectorAssembler
    rows = VectorAssembler(inputCols=["current_quantity_billed", "previous_fill_count", "prescription_age_days"],
                           outputCol="features").transform(observations(spark, 120, 8)).select("features", "label").cache()
    spec = mo.ModelSpec("XGBoost", "gbt_depthwise", {"n_estimators": 3, "max_depth": 2, "subsample": 0.7})
    boosted = mo._classifier(spec, 120)
    assert not boosted.getCacheNodeIds()
    trees = [c.fit(rows).toDebugString.split("\n", 1)[1] for c in (boosted, boosted.copy({boosted.cacheNodeIds: True}))]
    assert trees[0] == trees[1] and "Tree 2" in trees[0]
    assert mo._classifier(mo.ModelSpec("Random Forest", "random_forest", {}), 120).getCacheNodeIds()


def test_fits_run_side_by_side(spark):
    """Every fit waits for the others to have begun: one after the other they would never end."""
    import threading
    data, gate = observations(spark, 8), threading.Barrier(4)

    def fitter(spec, train):
        gate.wait(timeout=60)
        return spec.name
    assert mo.fit_all(mo.TUNED_SPECS, data, fitter) == [s.name for s in mo.TUNED_SPECS]


def test_all_folds_share_one_queue(spark, monkeypatch):
    """The fits of two folds wait for each other, and each trial still gets the mean over its folds."""
    import threading
    rows = observations(spark, 120, 9).withColumn("position", F.row_number().over(Window.orderBy("observation_id")) - 1)
    folds = rows.withColumn("validation_fold", F.when(F.col("position") >= 90, 2).when(F.col("position") >= 60, 1).otherwise(0))
    monkeypatch.setitem(mo.SEARCH_GRIDS, "logistic_regression", {"C": [0.1], "penalty": ["l2"]})
    gate, made = threading.Barrier(2), mo._classifier

    def waiting(spec, n):
        gate.wait(timeout=120)
        return made(spec, n)
    monkeypatch.setattr(mo, "_classifier", waiting)
    [(params, ap)] = mo._search("logistic_regression", "Logistic Regression", folds, None, None, mo.MODEL_FEATURE_COLUMNS)
    assert params == {"C": 0.1, "penalty": "l2"} and 0 < ap <= 1
