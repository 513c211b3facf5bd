"""Searches of the linear family read all folds out of one written copy; fits of many rows do not run side by side."""

from pyspark.sql import functions as F
from test_linear_search import observations

from ledger_spark.operators import models as mo
from ledger_spark.operators import prep
from ledger_spark.operators.prep import MODEL_FEATURE_COLUMNS


def test_linear_folds_are_written_once(spark, monkeypatch):
    """One copy of the training rows, whatever the number of folds; vectors and scores are those of folds dealt one by one."""
    cuts = []
    rows = observations(spark, 240).withColumn("patient_name", F.lit("x" * 50)).withColumn(
        "observation_date", F.date_add(F.lit("2026-01-01").cast("date"), F.substring("observation_id", 2, 4).cast("int")))
    folds = prep.time_folds(rows)
    cut = mo.cut_lineage
    monkeypatch.setattr(mo, "cut_lineage", lambda df: cuts.append(df.columns) or cut(df))
    monkeypatch.setattr(mo, "LINEAR_PARTITION_ROWS", 100)
    found = mo.prepared_folds(folds, True, MODEL_FEATURE_COLUMNS)
    assert len(found) == 5 and len(cuts) == 1 and "patient_name" not in cuts[0]
    for fold in found:
        start = folds.filter(F.col("validation_fold") == fold.number).agg(F.min("position")).first()[0]
        before = folds.filter(F.col("position") < start)
        pre = mo._preprocess_stage(before, True)
        asm = mo.VectorAssembler(inputCols=[mo._in(c) for c in MODEL_FEATURE_COLUMNS], outputCol="features")

        def near(df):
            return sorted((r.label, *(round(float(v), 9) for v in r.features.toArray())) for r in df.select("features", "label").collect())
        assert near(fold.fit) == near(asm.transform(pre.transform(before))) and fold.fit_rows == before.count()
        assert fold.fit.rdd.getNumPartitions() == -(-fold.fit_rows // 100)
        assert fold.held_out.count() == folds.filter(F.col("validation_fold") == fold.number).count()


def test_fits_of_many_rows_go_one_by_one(spark):
    df = spark.range(1)
    assert mo._fit_threads(df, 1000) >= 4 and mo._fit_threads(df, mo.SIDE_BY_SIDE_ROWS) == 1
    assert mo._fit_threads(df, 30_000_000) == 1
