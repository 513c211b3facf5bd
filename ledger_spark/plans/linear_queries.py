"""Registered queries over the scores of the stored linear model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledger_spark.operators import linear
from ledger_spark.operators import metrics as me
from ledger_spark.operators import prep
from ledger_spark.operators.quantiles import exact_quantiles
from ledger_spark.plans.eval_queries import _PREPARED_CTE, _ranking_sql, BOUNDS, LABEL, scored_sql
from ledger_spark.plans.registry import register
from ledger_spark.plans.research_queries import MODEL_AFTER_DAYS, observations
from ledger_spark.session import materialized

_COLUMNS = prep.MODEL_FEATURE_COLUMNS


def labelled(spark, sf_dir, after: int):
    split = prep.chronological_split(observations(spark, sf_dir, after), BOUNDS)
    return split.withColumn("label", F.col(LABEL))


def stored_linear(spark, sf_dir, after: int) -> linear.LinearModel:
    """The recorded coefficients over this data set's train rows, stored as a table and compiled from it."""
    table = materialized(spark, ("linear_model", sf_dir, after), lambda: linear.from_recorded(labelled(spark, sf_dir, after)))
    return linear.from_table(table)


# One row: the train rows' means, spreads, median and positive rate.
LINEAR_STATS_SQL = _PREPARED_CTE + ", lin AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{i}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS s_{i}" for i, c in enumerate(_COLUMNS)
) + f", avg({LABEL}) AS rate, (SELECT m FROM med) AS median_std FROM prepared WHERE split = 'train')\n"


def _value(c: str) -> str:
    if c == prep.MISSING_STD_INDICATOR:
        return f"CAST({prep.MISSING_STD_COLUMN} IS NOT NULL AS DOUBLE)"
    return f"coalesce({c}, median_std)" if c == prep.MISSING_STD_COLUMN else c


LINEAR_SCORE_SQL = "(1.0::DOUBLE / (1.0::DOUBLE + exp(-(ln(rate / (1 - rate)) + " + " + ".join(
    f"{linear.RECORDED_COEFFICIENTS[c]}::DOUBLE * ((CAST({_value(c)} AS DOUBLE) - m_{i}) / s_{i})" for i, c in enumerate(_COLUMNS)
) + "))))"


def linear_sql(select: str) -> str:
    return scored_sql(LINEAR_STATS_SQL + f", linear AS (SELECT observation_id, split, label, {LINEAR_SCORE_SQL} AS score "
                      f"FROM split_obs, lin)\n{select}")


def linear_scores(spark, sf_dir):
    """Observations of all splits with the linear score; null where a feature other than the spread is null."""
    model = stored_linear(spark, sf_dir, MODEL_AFTER_DAYS)
    return labelled(spark, sf_dir, MODEL_AFTER_DAYS).select("observation_id", "split", "label", model.column().alias("score"))


@register("j_linear_scores", linear_sql("SELECT observation_id, split, label, score FROM linear"), ["score"])
def j_linear_scores(spark, sf_dir):
    """Every observation scored by the stored linear model in one projection (M5)."""
    return linear_scores(spark, sf_dir)


@register("j_linear_ranking", linear_sql(", sc AS (SELECT * FROM linear WHERE score IS NOT NULL)"
                                         + _ranking_sql("split", "sc") + "\nSELECT * FROM rank_m"), ["pr_auc", "roc_auc"])
def j_linear_ranking(spark, sf_dir):
    """Average precision and ROC-AUC per split over continuous scores."""
    return me.ranking_metrics(linear_scores(spark, sf_dir).where("score IS NOT NULL"), ["split"])


_QUANTILES = {"q10": 0.10, "q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.90}


@register("j_linear_quantiles", linear_sql(f"""
, outc AS (SELECT *, CASE WHEN score >= {me.LOCKED_THRESHOLD} THEN CASE WHEN label = 1 THEN 'TP' ELSE 'FP' END
                          WHEN label = 1 THEN 'FN' ELSE 'TN' END AS outcome
           FROM linear WHERE split = 'test' AND score IS NOT NULL)
SELECT outcome, count(*) AS count, avg(score) AS mean, min(score) AS min, max(score) AS max, {', '.join(
    f'quantile_cont(score, {q}) AS {n}' for n, q in _QUANTILES.items())}
FROM outc GROUP BY outcome"""), ["mean", "min", "max", *_QUANTILES])
def j_linear_quantiles(spark, sf_dir):
    """Distribution of continuous scores by outcome on test."""
    test = linear_scores(spark, sf_dir).where("split = 'test' AND score IS NOT NULL").withColumn("outcome", me.outcome_label())
    base = test.groupBy("outcome").agg(F.count(F.lit(1)).alias("count"), F.avg("score").alias("mean"),
                                       F.min("score").alias("min"), F.max("score").alias("max"))
    return base.join(exact_quantiles(test, ["outcome"], "score", _QUANTILES), "outcome")
