"""Fills lie in buckets of patients: work by patient needs no exchange, and results are those of the plain path."""

import datetime as dt
import random

import pytest

from ledger_spark.operators import features as fe
from ledger_spark.session import co_partitioned, write_table

FILL = ("fill_id string, patient_id string, medication_id string, ndc string, prescription_id string, fill_date date, "
        "days_supply int, quantity_billed double, refill_number int, refills_remaining int")
RX = "prescription_id string, patient_id string, ndc string, prescription_date date"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _tables(spark, seed):
    rng, start = random.Random(seed), dt.date(2026, 1, 1)
    rx = [(f"x{i}", rng.choice(["p", "q", "r"]), rng.choice(["1", "2", None]),
           None if i % 9 == 0 else start + dt.timedelta(days=rng.randint(0, 60))) for i in range(40)]
    fills = []
    for i in range(160):
        name, patient, ndc, day = rng.choice(rx)
        fills.append((f"f{i}", rng.choice([patient, "s"]), rng.choice("MN"), rng.choice([ndc, "2", None]), name,
                      (day or start) + dt.timedelta(days=rng.randint(0, 40)), rng.choice([3, 30]), 1.0 * i, i % 3, 2 - i % 3))
    return spark.createDataFrame(fills, FILL), spark.createDataFrame(rx, RX)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_look_ups_by_patient_equal_the_plain_ones(spark, seed):
    fills, rx = _tables(spark, seed)
    plain = sorted(map(str, fe.candidate_features(fills, rx).collect()))
    dealt = write_table(fills.repartition(5, "patient_id"), "Fills/by patient", buckets=(5, ["patient_id"]))
    with co_partitioned(spark):
        got = fe.candidate_features(dealt, rx, by_patient=5, checkpoint=lambda name, df: write_table(df, name)).collect()
    assert sorted(map(str, got)) == plain and len(plain) == 160


def test_wide_rows_are_not_shuffled(spark):
    fills, rx = _tables(spark, 4)
    dealt = write_table(fills.repartition(5, "patient_id"), "fills", buckets=(5, ["patient_id"]))
    with co_partitioned(spark):
        plan = _plan(fe.candidate_features(dealt, rx, by_patient=5, checkpoint=lambda name, df: write_table(df, name)))
    deals = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not [line for line in deals if "isnull" in line or "_bd" in line or "_obs_day" in line], deals
    was = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    assert was == "true"


def test_stored_histories_are_read_without_an_exchange(spark, sf_dir):
    from ledger_spark.plans import research_queries as rq
    from pyspark.sql import Window, functions as F
    history = Window.partitionBy("patient_id", "medication_id").orderBy("fill_date", "fill_id")
    assert "Exchange" not in _plan(rq.fills(spark, sf_dir).withColumn("n", F.row_number().over(history)))


def test_a_patient_of_very_many_lines_is_dealt_in_blocks(spark, sf_dir, monkeypatch):
    from ledger_spark.sources import derive
    usual = derive.fill_buckets(spark, sf_dir)
    assert usual == derive.LEAST_BUCKETS
    whole = derive.fills(spark, sf_dir)
    assert derive.fills(spark, sf_dir, usual).exceptAll(whole).count() == 0
    monkeypatch.setattr(derive, "LONG_HISTORY_ROWS", 1)
    assert derive.fill_buckets(spark, sf_dir) is None
