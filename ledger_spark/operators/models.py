"""Classifier fitting, scoring, search and interpretation with Spark ML.

Preprocessing is fitted on the training rows only and baked into a
``PipelineModel`` as SQL stages, so the saved model (L6) applies exactly the
train median, the availability indicator and (for the linear model) the
population standardization.  Gradient boosting families are approximated by
``GBTClassifier`` (Spark ML's only boosted trees): no L1/L2 leaf penalty, and
leaf-wise growth becomes a depth limit.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LogisticRegression,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledger_spark.operators import metrics as me
from ledger_spark.operators.quantiles import exact_median
from ledger_spark.operators.scan import blocked_running
from ledger_spark.operators.features import FEATURE_COLUMNS
from ledger_spark.operators.prep import MISSING_STD_COLUMN, MISSING_STD_INDICATOR, MODEL_FEATURE_COLUMNS, require_assigned
from ledger_spark.session import cut_lineage

SEED = 20260814
LABEL = "label"


@dataclass(frozen=True)
class ModelSpec:
    name: str
    family: str            # logistic_regression | random_forest | gbt_depthwise | gbt_leafwise
    params: dict = field(default_factory=dict)


# Baseline and tuned configurations of the four families.
BASELINE_SPECS = (
    ModelSpec("Logistic Regression", "logistic_regression", {"C": 1.0, "penalty": "l2"}),
    ModelSpec("Random Forest", "random_forest", {"n_estimators": 300}),
    ModelSpec("XGBoost", "gbt_depthwise", {"n_estimators": 300, "max_depth": 3, "learning_rate": 0.05}),
    ModelSpec("LightGBM", "gbt_leafwise", {"n_estimators": 300, "num_leaves": 31, "learning_rate": 0.05}),
)
TUNED_SPECS = (
    ModelSpec("Logistic Regression", "logistic_regression", {"C": 0.01, "penalty": "l2"}),
    ModelSpec("Random Forest", "random_forest",
              {"n_estimators": 200, "max_depth": 12, "min_samples_leaf": 2, "max_features": "sqrt"}),
    ModelSpec("XGBoost", "gbt_depthwise",
              {"n_estimators": 400, "max_depth": 4, "learning_rate": 0.02, "subsample": 1.0}),
    ModelSpec("LightGBM", "gbt_leafwise",
              {"n_estimators": 250, "num_leaves": 7, "max_depth": 5, "learning_rate": 0.05,
               "subsample": 0.85, "min_child_samples": 80}),
)
SEARCH_GRIDS = {
    "logistic_regression": {"C": [0.01, 0.1, 0.5, 1, 2, 5, 10], "penalty": ["l1", "l2"]},
    "random_forest": {"n_estimators": [200, 400, 600], "max_depth": [3, 5, 8, 12, None],
                      "min_samples_leaf": [1, 2, 5, 10], "max_features": ["sqrt", "log2", 0.5, 1.0]},
    "gbt_depthwise": {"n_estimators": [150, 250, 400, 600], "learning_rate": [0.02, 0.05, 0.1],
                      "max_depth": [2, 3, 4, 5], "subsample": [0.7, 0.85, 1.0]},
    "gbt_leafwise": {"n_estimators": [150, 250, 400, 600], "learning_rate": [0.02, 0.05, 0.1],
                     "num_leaves": [7, 15, 31, 63], "min_child_samples": [10, 20, 40, 80],
                     "subsample": [0.7, 0.85, 1.0]},
}
SEARCH_TRIALS = {"logistic_regression": 10, "random_forest": 30, "gbt_depthwise": 40, "gbt_leafwise": 40}


def _in(c: str) -> str:
    return f"{c}__in"


def _preprocess_stage(train: DataFrame, standardize: bool,
                      features: Sequence[str] = MODEL_FEATURE_COLUMNS, as_they_lie: DataFrame | None = None) -> SQLTransformer:
    """Median imputation + indicator (+ population z-score) fitted on ``train`` (H2, H3, H7, H8).

    ``as_they_lie``: the same rows, not dealt anew; the median is exact in any order.
    """
    median = exact_median(train if as_they_lie is None else as_they_lie, MISSING_STD_COLUMN)
    if median is None:
        raise ValueError("Training data has no available refill-interval standard deviation.")
    raw = {c: f"`{c}`" for c in FEATURE_COLUMNS}
    raw[MISSING_STD_COLUMN] = f"coalesce(`{MISSING_STD_COLUMN}`, {float(median)!r})"
    raw[MISSING_STD_INDICATOR] = f"CAST(`{MISSING_STD_COLUMN}` IS NOT NULL AS INT)"
    exprs = {c: raw[c] for c in features}
    if standardize:
        stats_cols = []
        for c in features:
            stats_cols += [F.avg(F.expr(exprs[c])).alias(f"m{len(stats_cols)}"),
                           F.stddev_pop(F.expr(exprs[c])).alias(f"m{len(stats_cols) + 1}")]
        row = train.agg(*stats_cols).first()
        for i, c in enumerate(features):
            mean, std = row[2 * i], row[2 * i + 1]
            scale = std if std else 1.0
            exprs[c] = f"(({exprs[c]}) - {float(mean)!r}) / {float(scale)!r}"
    select = ", ".join(f"CAST({e} AS DOUBLE) AS `{_in(c)}`" for c, e in exprs.items())
    return SQLTransformer(statement=f"SELECT *, {select} FROM __THIS__")


# A forest's rows keep the node they have reached, so a pass need not ship the grown trees; results are the same.
TREE_CACHE = {"cacheNodeIds": True, "checkpointInterval": 10, "maxMemoryInMB": 1024}
# The one shallow tree of a boosting round is walked sooner than a cache of its nodes is made anew; same results too.
BOOST_CACHE = TREE_CACHE | {"cacheNodeIds": False}


LOGISTIC_ITERATIONS = 500


def _classifier(spec: ModelSpec, n_train: int):
    p = spec.params
    if spec.family == "logistic_regression":
        c = float(p.get("C", 1.0))
        # sklearn minimizes 1/2||w||^2 + C * sum(loss); Spark mean(loss) + reg/2 ||w||^2
        return LogisticRegression(featuresCol="features", labelCol=LABEL, regParam=1.0 / (c * n_train),
                                  elasticNetParam=1.0 if p.get("penalty") == "l1" else 0.0,
                                  standardization=False, maxIter=p.get("max_iter", LOGISTIC_ITERATIONS), tol=1e-8)
    if spec.family == "random_forest":
        mf = p.get("max_features", "sqrt")
        strategy = {"sqrt": "sqrt", "log2": "log2", 1.0: "all"}.get(mf, str(mf))
        depth = p.get("max_depth") or 30
        return RandomForestClassifier(featuresCol="features", labelCol=LABEL, seed=SEED,
                                      numTrees=int(p.get("n_estimators", 100)), maxDepth=min(depth, 30),
                                      minInstancesPerNode=int(p.get("min_samples_leaf", 1)),
                                      featureSubsetStrategy=strategy, **TREE_CACHE)
    depth = p.get("max_depth") or 0
    if spec.family == "gbt_leafwise":
        leaves_depth = max(1, (int(p.get("num_leaves", 31)) - 1).bit_length())
        depth = min(depth, leaves_depth) if depth and depth > 0 else leaves_depth
    return GBTClassifier(featuresCol="features", labelCol=LABEL, seed=SEED,
                         maxIter=int(p.get("n_estimators", 100)), maxDepth=int(depth or 3),
                         stepSize=float(p.get("learning_rate", 0.1)),
                         subsamplingRate=float(p.get("subsample", 1.0)),
                         minInstancesPerNode=int(p.get("min_child_samples", 1)), **BOOST_CACHE)


#: Rows of one partition in a fit.  Bagging draws by partition, so their number follows from the rows alone.
FIT_PARTITION_ROWS = 20_000
#: The same for the linear family, whose every iteration is one light task a partition.
LINEAR_PARTITION_ROWS = 200_000


def _dealt(train: DataFrame, n: int, features: Sequence[str], linear: bool) -> DataFrame:
    """Rows dealt by a hash of their id and sorted, into as many partitions as their number asks for."""
    rows = LINEAR_PARTITION_ROWS if linear else FIT_PARTITION_ROWS
    key = ["observation_id"] if "observation_id" in train.columns else [c for c in features if c in train.columns]
    return train.repartition(max(1, -(-n // rows)), *key).sortWithinPartitions(*key)


def fit(spec: ModelSpec, train: DataFrame, features: Sequence[str] = MODEL_FEATURE_COLUMNS) -> PipelineModel:
    """Fit preprocessing + classifier on training rows with a ``label`` column.

    Rows are dealt as ``_dealt`` says: the same rows give the same model
    wherever they were read from and whatever the session's settings are.
    """
    n = train.count()
    linear = spec.family == "logistic_regression"
    dealt = _dealt(train, n, features, linear)
    pre = _preprocess_stage(dealt, linear, features, train)
    asm = VectorAssembler(inputCols=[_in(c) for c in features], outputCol="features")
    return Pipeline(stages=[pre, asm, _classifier(spec, n)]).fit(dealt)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Input rows plus ``score`` = P(renewal) (M5 with a fitted model)."""
    out = model.transform(df)
    drop = [c for c in out.columns if c.endswith("__in")] + ["features", "rawPrediction", "probability",
                                                              "prediction"]
    return out.withColumn("score", vector_to_array("probability")[1]).drop(*drop)


#: Rows that fits side by side may hold together; each keeps a copy of its own, in memory or on disk.
SIDE_BY_SIDE_ROWS = 10_000_000


def _fit_threads(df: DataFrame, rows: int = 1) -> int:
    """Fits that run side by side: a fit of few rows keeps one core busy, so as many as the cluster has cores.

    Fits of many ``rows`` fill the cluster on their own and go one by one.
    """
    return max(1, min(max(4, df.sparkSession.sparkContext.defaultParallelism), SIDE_BY_SIDE_ROWS // max(rows, 1)))


def compare(specs: Sequence[ModelSpec], split_df: DataFrame, threads: int = 4,
            fitter=None) -> DataFrame:
    """Fit each spec on train, evaluate train and validation at 0.50.

    ``fitter(spec, train)`` defaults to ``fit``; callers may pass a cached one.
    """
    require_assigned(split_df)
    train = split_df.filter(F.col("split") == "train")
    fit_on = split_df.filter(F.col("split").isin("train", "validation"))
    fitter = fitter or fit

    def one(spec: ModelSpec) -> DataFrame:
        model = fitter(spec, train)
        scored = score(model, fit_on).withColumn("model_name", F.lit(spec.name))
        return me.evaluation_summary(scored, ["model_name", "split"])

    with ThreadPoolExecutor(max_workers=threads) as pool:
        parts = list(pool.map(one, specs))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fit_all(specs: Sequence[ModelSpec], train: DataFrame, fitter=None) -> list[PipelineModel]:
    """The model of each spec, fitted side by side."""
    with ThreadPoolExecutor(max_workers=_fit_threads(train)) as pool:
        return list(pool.map(lambda spec: (fitter or fit)(spec, train), specs))


def model_scores(specs: Sequence[ModelSpec], split_df: DataFrame, fitter=None) -> DataFrame:
    """Rows of every split scored by each spec fitted on train, stacked with ``model_name``."""
    models = fit_all(specs, split_df.filter(F.col("split") == "train"), fitter)
    return reduce(DataFrame.unionByName, [score(model, split_df).withColumn("model_name", F.lit(spec.name))
                                          for spec, model in zip(specs, models)])


def sample_params(family: str, trials: int, seed: int = SEED) -> list[dict]:
    """Seeded distinct draws from the discrete grid; all of a grid that has no more than ``trials`` points."""
    grid = SEARCH_GRIDS[family]
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    return random.Random(seed).sample(points, min(trials, len(points)))


@dataclass(frozen=True)
class Fold:
    """One expanding fold, preprocessed on its own fit rows: (features, label) of both parts."""
    number: int
    fit_rows: int
    fit: DataFrame
    held_out: DataFrame


def prepared_folds(train_folds: DataFrame, standardize: bool, features: Sequence[str]) -> list[Fold]:
    """Every fold's vectors; all trials of a search read these instead of preparing the fold again.

    Tree fits read vectors written once a fold.  Linear fits (``standardize``) read all folds out of one copy of
    the rows, dealt once: the vectors of expanding folds would be written two and a half times over.
    """
    used = [c for c in FEATURE_COLUMNS if c in features or c == MISSING_STD_COLUMN]
    train_folds = train_folds.select("position", "validation_fold", LABEL, *used, *(
        c for c in ("observation_id",) if c in train_folds.columns))
    if standardize:
        train_folds = cut_lineage(_dealt(train_folds, train_folds.count(), features, True))
    bounds = {r["validation_fold"]: r["start"] for r in train_folds.filter("validation_fold > 0").groupBy("validation_fold")
              .agg(F.min("position").alias("start")).collect()}          # one row per fold
    out = []
    for number, start in sorted(bounds.items()):
        before = train_folds.filter(F.col("position") < start)
        n = before.count()
        pre = _preprocess_stage(before, standardize, features)
        asm = VectorAssembler(inputCols=[_in(c) for c in features], outputCol="features")

        def vectors(rows: DataFrame) -> DataFrame:
            made = asm.transform(pre.transform(rows)).select("features", F.col(LABEL).cast("double").alias(LABEL))
            return made if standardize else cut_lineage(made)
        if standardize:      # fewer rows, fewer tasks an iteration
            fit_rows = before.coalesce(max(1, -(-n // LINEAR_PARTITION_ROWS)))
        else:
            fit_rows = _dealt(before, n, features, False)
        out.append(Fold(number, n, vectors(fit_rows),
                        vectors(train_folds.filter(F.col("validation_fold") == number))))
    return out


def _rounds(params: dict) -> int:
    return int(params.get("n_estimators", 0))


def _prefix(params: dict) -> tuple:
    """What trials must share to be stages of one fit: everything but the number of trees."""
    return tuple(sorted((k, str(v)) for k, v in params.items() if k != "n_estimators"))


def first_trees(model, n: int):
    """The ensemble of a fitted model's first ``n`` trees; the model itself if it has no more."""
    if not hasattr(model, "trees") or n >= len(model.trees):
        return model
    sc, java = SparkContext.getOrCreate(), model._java_obj      # in a worker thread no session is active
    jvm = sc._jvm.org.apache.spark.ml
    boosted = isinstance(model, GBTClassificationModel)
    kind = jvm.regression.DecisionTreeRegressionModel if boosted else jvm.classification.DecisionTreeClassificationModel
    trees = sc._gateway.new_array(kind, n)
    for i, tree in enumerate(java.trees()[:n]):
        trees[i] = tree
    if boosted:
        weights = sc._gateway.new_array(sc._gateway.jvm.double, n)
        for i, w in enumerate(java.treeWeights()[:n]):
            weights[i] = w
        made = GBTClassificationModel(jvm.classification.GBTClassificationModel(java.uid(), trees, weights))
    else:
        made = RandomForestClassificationModel(
            jvm.classification.RandomForestClassificationModel(java.uid(), trees, java.numFeatures(), java.numClasses()))
    return made.setFeaturesCol("features")


def _search(family: str, name: str, train_folds: DataFrame, trials: int | None, threads: int | None,
            features: Sequence[str]) -> list[tuple[dict, float]]:
    """Mean AP of each draw over the folds.

    Draws that differ only in the number of trees are stages of one fit with
    the most of them.  The fits of all folds share one queue, the largest fold's
    first, and each is dropped once its held-out scores are written; all held-out
    scores of a fold are ranked in one job.
    """
    draws = sample_params(family, trials or SEARCH_TRIALS[family])
    groups: dict[tuple, list[int]] = {}
    for i, params in enumerate(draws):
        groups.setdefault(_prefix(params), []).append(i)
    folds = prepared_folds(train_folds, family == "logistic_regression", features)

    def scores(fold: Fold, members: list[int]) -> DataFrame:
        longest = max((draws[i] for i in members), key=_rounds)
        model = _classifier(ModelSpec(name, family, longest), fold.fit_rows).fit(fold.fit)
        parts = [first_trees(model, _rounds(draws[i]) or 1).transform(fold.held_out).select(
            F.lit(i).alias("trial"), LABEL, vector_to_array("probability")[1].alias("score")) for i in members]
        return cut_lineage(reduce(DataFrame.unionByName, parts))

    totals = [0.0] * len(draws)
    most = max((fold.fit_rows for fold in folds), default=1)
    with ThreadPoolExecutor(max_workers=threads or _fit_threads(train_folds, most)) as pool:
        queued = [[pool.submit(scores, fold, m) for m in groups.values()] for fold in reversed(folds)]
        for parts in reversed(queued):
            stacked = reduce(DataFrame.unionByName, [part.result() for part in parts])
            for row in me.ranking_metrics(stacked, ["trial"]).collect():         # one row per trial
                totals[row["trial"]] += row["pr_auc"] or 0.0
    return [(params, total / len(folds)) for params, total in zip(draws, totals)]


def randomized_search(family: str, name: str, train_folds: DataFrame, trials: int | None = None,
                      threads: int | None = None, features: Sequence[str] = MODEL_FEATURE_COLUMNS) -> DataFrame:
    """Mean AP over expanding time folds for each sampled configuration.

    ``train_folds`` carries ``position`` and ``validation_fold`` (H9): fold k fits
    on positions before its validation rows.  Fits run from a driver thread pool, by default one a core.
    """
    results = _search(family, name, train_folds, trials, threads, features)
    rows = [(name, i, str(sorted(p.items())), float(ap)) for i, (p, ap) in enumerate(results)]
    return train_folds.sparkSession.createDataFrame(
        rows, "model_name string, trial int, params string, cv_pr_auc double")


def tune_models(split_df: DataFrame, train_folds: DataFrame, trials: dict[str, int] | None = None,
                threads: int | None = None, features: Sequence[str] = MODEL_FEATURE_COLUMNS) -> DataFrame:
    """Search each family, refit its best configuration on all of train, evaluate train and validation.

    ``trials``: searches per family, default ``SEARCH_TRIALS``; of equal scores the earlier trial is best.
    """
    train = split_df.filter(F.col("split") == "train")
    fit_on = split_df.filter(F.col("split").isin("train", "validation"))
    out = None
    for spec in BASELINE_SPECS:
        n = (trials or SEARCH_TRIALS).get(spec.family)
        if n is None:
            continue
        results = _search(spec.family, spec.name, train_folds, n, threads, features)
        best, ap = max(results, key=lambda r: r[1])
        model = fit(ModelSpec(spec.name, spec.family, best), train, features)
        scored = score(model, fit_on).withColumn("model_name", F.lit(spec.name))
        part = me.evaluation_summary(scored, ["model_name", "split"]).select(
            "*", F.lit(len(results)).alias("trials"), F.lit(float(ap)).alias("best_cv_pr_auc"),
            F.lit(str(sorted(best.items()))).alias("best_parameters"))
        out = part if out is None else out.unionByName(part)
    return out


def coefficient_table(model: PipelineModel, features: Sequence[str] = MODEL_FEATURE_COLUMNS) -> DataFrame:
    """Coefficient, |coefficient|, direction; sorted by |coefficient| (K1)."""
    lr = model.stages[-1]
    spark = SparkSession.getActiveSession()
    rows = [(f, float(c)) for f, c in zip(features, lr.coefficients.toArray())]
    df = spark.createDataFrame(rows, "feature string, coefficient double")
    return df.select("feature", "coefficient", F.abs("coefficient").alias("absolute_coefficient"),
                     F.when(F.col("coefficient") >= 0, "positive").otherwise("negative").alias("direction"))


NEUTRAL_TOLERANCE = 0.01


def odds_ratios(coefficients: DataFrame) -> DataFrame:
    """exp(coefficient) per one standard deviation, with a neutral band (K2)."""
    c = F.col("coefficient")
    return coefficients.select(
        "feature", "coefficient", F.exp(c).alias("odds_ratio"),
        F.when(F.abs(c) < NEUTRAL_TOLERANCE, "approximately neutral")
        .when(c > 0, "increases predicted renewal odds")
        .otherwise("decreases predicted renewal odds").alias("direction"))


def coefficient_contract(coefficients: DataFrame, expected: dict[str, float], tol: float = 5e-8) -> DataFrame:
    """Rows whose coefficient differs from the recorded value by more than ``tol`` (K3)."""
    spark = coefficients.sparkSession
    exp_df = spark.createDataFrame(list(expected.items()), "feature string, expected double")
    j = coefficients.join(exp_df, "feature", "full")
    return j.filter(F.col("expected").isNull() | F.col("coefficient").isNull()
                    | (F.abs(F.col("coefficient") - F.col("expected")) > tol))


def tree_importance(model: PipelineModel, features: Sequence[str] = MODEL_FEATURE_COLUMNS) -> DataFrame:
    """Impurity importance, ranked (K5)."""
    tree = model.stages[-1]
    spark = SparkSession.getActiveSession()
    rows = [(f, float(v)) for f, v in zip(features, tree.featureImportances.toArray())]
    df = spark.createDataFrame(rows, "feature string, importance double")
    w = Window.orderBy(F.col("importance").desc(), "feature")   # 16 rows
    return df.withColumn("rank", F.row_number().over(w))


def combined_ranks(tables: dict[str, DataFrame]) -> DataFrame:
    """One-to-one join of rank tables, sorted by the ranks in order (K6)."""
    out = None
    for name, t in tables.items():
        r = t.select("feature", F.col("rank").alias(f"{name}_rank"))
        out = r if out is None else out.join(r, "feature", "inner")
    return out.orderBy(*[f"{n}_rank" for n in tables])


#: Width of a block of the donors' hash order: 256 blocks, so their offsets are at most 256 rows a copy.
PERMUTATION_BLOCK = 2.0 ** 56


def permutation_importance(model: PipelineModel, data: DataFrame, repeats: int = 30,
                           features: Sequence[str] = FEATURE_COLUMNS, seed: int = SEED) -> DataFrame:
    """Mean and population std of the AP drop when one input is shuffled (K4).

    All (feature, repeat) copies are scored in one job; ``_g`` numbers them, -1
    is the unshuffled data.  Copy (f, r) gives row i the value of f from the row
    whose rank under a seeded hash order equals i's rank under the base order.
    The base order is ranked once; of the copies only the donor values are
    ranked, so the rows themselves are never copied before they are scored.
    Both ranks are blocked running counts (hash buckets as blocks), so no task
    orders a whole copy.
    """
    names = list(features)
    inputs = [c for c in data.columns if c in names or c in FEATURE_COLUMNS or c == LABEL]
    base = data.withColumn("_rid", F.xxhash64(*[F.col(c) for c in data.columns])).select(
        "_rid", *inputs, F.lit(0).alias("_one"))
    placed = blocked_running(base.withColumn("_ba", F.floor(F.col("_rid") / 2.0 ** 54).cast("long")),
                             ["_one"], "_ba", ["_rid"], position="_pos").select("_pos", *inputs)
    nth = F.floor(F.col("_g") / repeats).cast("int") + 1
    feature = F.element_at(F.array(*[F.lit(f) for f in names]), nth)
    donors = base.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(len(names) * repeats - 1)))).select(
        "_g", F.element_at(F.array(*[F.col(f).cast("double") for f in names]), nth).alias("_donor"),
        F.xxhash64("_rid", feature, (F.col("_g") % repeats).cast("int"), F.lit(seed)).alias("_kb"))
    donors = blocked_running(donors.withColumn("_bb", F.floor(F.col("_kb") / PERMUTATION_BLOCK).cast("long")),
                             ["_g"], "_bb", ["_kb"], position="_dpos", many_groups=True).select("_g", "_dpos", "_donor")
    # a plan's size estimate leaves out the copies: without the hint the donors of all of them go to the driver
    shuffled = donors.hint("merge").join(placed, F.col("_pos") == F.col("_dpos"))
    replaced = shuffled.select(*[F.when(nth == names.index(f) + 1, F.col("_donor")).otherwise(F.col(f)).alias(f)
                                 if f in names else F.col(f) for f in inputs], "_g")
    unshuffled = data.select(*inputs, F.lit(-1).alias("_g"))
    scored = score(model, replaced.unionByName(unshuffled)).select("_g", LABEL, "score")
    ap = me.ranking_metrics(scored, ["_g"], many_groups=True)
    # one row per (feature, repeat) plus the baseline: a tiny table
    base_ap = F.max(F.when(F.col("_g") == -1, F.col("pr_auc"))).over(Window.partitionBy())
    drops = ap.select("_g", (base_ap - F.col("pr_auc")).alias("drop")).filter("_g >= 0").select(
        feature.alias("feature"), "drop")
    summary = drops.groupBy("feature").agg(F.avg("drop").alias("mean_importance"),
                                           F.stddev_pop("drop").alias("standard_deviation"))
    w = Window.orderBy(F.col("mean_importance").desc(), "feature")   # one row per feature
    return summary.withColumn("rank", F.row_number().over(w))
