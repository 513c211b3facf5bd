"""A stored linear model as one column expression and the same SQL text.

A saved pipeline is imputation, availability indicator, standardization and a
logistic classifier.  Its numbers fit in a table of one row per feature, so
scoring needs no pipeline stages, vectors or Python: the compiled column is a
plain expression that Catalyst fuses into the scan, and its SQL text runs in
any engine.  A pipeline that does not have this form is refused.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledger_spark.functions.rules import LOCKED_THRESHOLD
from ledger_spark.operators import prep
from ledger_spark.operators.prep import MISSING_STD_COLUMN, MISSING_STD_INDICATOR, MODEL_FEATURE_COLUMNS

# The recorded coefficients of the locked model, per standard deviation.
RECORDED_COEFFICIENTS = {
    "previous_on_time_fill_rate": 0.49936279,
    "average_previous_timing_gap_days": -0.13421066,
    "previous_fill_count": 0.11387149,
    "previous_early_fill_rate": -0.06458892,
    "latest_refill_timing_gap_days": -0.05895071,
    "refill_interval_std_available": -0.05106063,
    "medication_prior_fill_count": 0.04926908,
    "average_previous_refill_interval_days": -0.04845641,
    "medication_prior_average_days_supply": 0.04333492,
    "current_refill_number": -0.01875323,
    "current_quantity_billed": 0.01754541,
    "medication_prior_average_quantity": -0.01658121,
    "std_previous_refill_interval_days": -0.01228752,
    "current_days_supply": 0.00956247,
    "days_since_previous_fill": -0.00800432,
    "prescription_age_days": -0.00028218,
}
TABLE_SCHEMA = "position int, feature string, weight double, mean double, scale double, impute double, intercept double"


@dataclass(frozen=True)
class Term:
    """One feature: its weight per scale, and what stands in for a null (no entry: a null score)."""
    feature: str
    weight: float
    mean: float
    scale: float
    impute: float | None = None


@dataclass(frozen=True)
class LinearModel:
    terms: tuple[Term, ...]
    intercept: float
    threshold: float = LOCKED_THRESHOLD

    def column(self) -> Column:
        """The probability as a column over the 15 raw features."""
        return F.expr(self.sql("`"))

    def sql(self, quote: str = '"') -> str:
        """The probability as SQL text over the 15 raw features."""
        def value(t: Term) -> str:
            if t.feature == MISSING_STD_INDICATOR:
                return f"CASE WHEN {quote}{MISSING_STD_COLUMN}{quote} IS NULL THEN 0e0 ELSE 1e0 END"
            c = f"CAST({quote}{t.feature}{quote} AS DOUBLE)"
            return c if t.impute is None else f"coalesce({c}, {_number(t.impute)})"
        margin = " + ".join([_number(self.intercept), *(
            f"{_number(t.weight)} * (({value(t)} - {_number(t.mean)}) / {_number(t.scale)})" for t in self.terms)])
        return f"(1e0 / (1e0 + exp(-({margin}))))"

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per feature, in order; what is stored instead of a pipeline."""
        return spark.createDataFrame([(i, t.feature, t.weight, t.mean, t.scale, t.impute, self.intercept)
                                      for i, t in enumerate(self.terms)], TABLE_SCHEMA)


def _number(v: float) -> str:
    """A double literal of Spark and of standard SQL (a plain 0.1 would be a decimal); negative ones in brackets."""
    text = repr(float(v))
    text = text if "e" in text else f"{text}e0"
    return f"({text})" if v < 0 else text


class ModelContractError(RuntimeError):
    """The stored model is not the locked linear model."""


def from_table(stored: DataFrame, features: tuple[str, ...] = MODEL_FEATURE_COLUMNS) -> LinearModel:
    """The model of a stored table (one row per feature); refuses another set or order of features."""
    rows = stored.orderBy("position").limit(len(features) + 1).collect()
    if tuple(r["feature"] for r in rows) != tuple(features):
        raise ModelContractError("The stored terms are not the model features in order.")
    if len({r["intercept"] for r in rows}) != 1:
        raise ModelContractError("The stored terms have different intercepts.")
    terms = tuple(Term(r["feature"], r["weight"], r["mean"], r["scale"], r["impute"]) for r in rows)
    return _checked(LinearModel(terms, rows[0]["intercept"]))


def _checked(model: LinearModel) -> LinearModel:
    for t in model.terms:
        numbers = [t.weight, t.mean, t.scale, model.intercept] + ([] if t.impute is None else [t.impute])
        if any(n is None or not math.isfinite(n) for n in numbers) or t.scale <= 0:
            raise ModelContractError(f"The term of `{t.feature}` has no finite numbers or no positive scale.")
        if (t.impute is not None) != (t.feature == MISSING_STD_COLUMN):
            raise ModelContractError(f"`{t.feature}` is not imputed as the model asks.")
    return model


def from_recorded(prepared: DataFrame, coefficients: Mapping[str, float] = RECORDED_COEFFICIENTS,
                  label: str = "label") -> DataFrame:
    """The stored table of recorded coefficients over the train rows' means, scales and median (H2, H8).

    ``prepared`` has ``split``, ``label`` and the 15 raw features.  The intercept is the train rows' log odds,
    since the standardized features have mean 0.
    """
    imputed = prep.prepare_features(prepared)
    train = imputed.filter(F.col("split") == "train")
    ordered = list(MODEL_FEATURE_COLUMNS)
    stats = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(ordered)],
                      *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(ordered)],
                      F.avg(label).alias("rate"), F.max("std_imputation_median").alias("median"))
    entries = F.array(*[F.struct(
        F.lit(i).alias("position"), F.lit(c).alias("feature"), F.lit(float(coefficients[c])).alias("weight"),
        F.col(f"m{i}").alias("mean"), F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(1.0).alias("scale"),
        (F.col("median") if c == MISSING_STD_COLUMN else F.lit(None)).cast("double").alias("impute"),
        F.log(F.col("rate") / (1 - F.col("rate"))).alias("intercept")) for i, c in enumerate(ordered)])
    return stats.select(F.inline(entries))


_FLOAT = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_STAGE_COLUMN = re.compile(rf"CAST\(\(\((?P<value>.*?)\) - (?P<mean>{_FLOAT})\) / (?P<scale>{_FLOAT}) AS DOUBLE\) AS `(?P<name>\w+)__in`")


def from_pipeline(model: PipelineModel, features: tuple[str, ...] = MODEL_FEATURE_COLUMNS) -> LinearModel:
    """Compile a fitted or loaded pipeline; raises ``ModelContractError`` if it has another form."""
    stages = model.stages
    if [type(s) for s in stages] != [SQLTransformer, VectorAssembler, LogisticRegressionModel]:
        raise ModelContractError("Stages are not [preprocess, assemble, logistic].")
    pre, assemble, logistic = stages
    if tuple(c.removesuffix("__in") for c in assemble.getInputCols()) != tuple(features):
        raise ModelContractError("The feature order is another one.")
    if logistic.numFeatures != len(features) or logistic.numClasses != 2:
        raise ModelContractError("The classifier is not binary over the model features.")
    found = {m["name"]: m for m in _STAGE_COLUMN.finditer(pre.getStatement())}
    terms = []
    for feature, weight in zip(features, logistic.coefficients.toArray()):
        m = found.get(feature)
        if m is None:
            raise ModelContractError(f"`{feature}` is not standardized.")
        impute = None
        if feature == MISSING_STD_INDICATOR:
            wanted = f"CAST(`{MISSING_STD_COLUMN}` IS NOT NULL AS INT)"
        elif feature == MISSING_STD_COLUMN:
            filled = re.fullmatch(rf"coalesce\(`{feature}`, ({_FLOAT})\)", m["value"])
            if not filled:
                raise ModelContractError(f"`{feature}` is not imputed by a number.")
            impute, wanted = float(filled[1]), m["value"]
        else:
            wanted = f"`{feature}`"
        if m["value"] != wanted:
            raise ModelContractError(f"`{feature}` is prepared in another way.")
        terms.append(Term(feature, float(weight), float(m["mean"]), float(m["scale"]), impute))
    return _checked(LinearModel(tuple(terms), float(logistic.intercept), float(logistic.getThreshold())))


def coefficient_differences(model: LinearModel, recorded: Mapping[str, float] = RECORDED_COEFFICIENTS,
                            tolerance: float = 5e-8) -> dict[str, tuple[float | None, float | None]]:
    """Features whose weight is not the recorded one, with both values (K3); empty if the model is the recorded one."""
    own = {t.feature: t.weight for t in model.terms}
    return {f: (own.get(f), recorded.get(f)) for f in sorted({*own, *recorded})
            if f not in own or f not in recorded or abs(own[f] - recorded[f]) > tolerance}
