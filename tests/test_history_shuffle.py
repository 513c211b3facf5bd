"""Histories are shuffled once; long ones go in blocks with the same results."""

import datetime as dt
import random

import pytest

from ledger_spark.operators import features as fe

SCHEMA = "fill_id string, patient_id string, medication_id string, fill_date date, days_supply int"


def _fills(spark, seed, n=120):
    rng = random.Random(seed)
    rows = [(f"{rng.randint(1, 30)}-{i}", rng.choice("PQ"), rng.choice("MN"),
             None if rng.random() < 0.1 else dt.date(2026, 1, 1) + dt.timedelta(days=rng.randint(0, 25)),
             None if rng.random() < 0.1 else rng.choice([1, 3, 7])) for i in range(n)]
    return fe.prepare_fills(spark.createDataFrame(rows, SCHEMA))


@pytest.mark.parametrize("seed", [1, 2])
def test_blocked_histories_equal_whole_ones(spark, monkeypatch, seed):
    f = _fills(spark, seed)
    whole = sorted(map(str, fe.history_features(f).collect()))
    monkeypatch.setattr(fe, "LONG_HISTORY_ROWS", 0)
    assert sorted(map(str, fe.history_features(f).collect())) == whole and len(whole) > 80


def test_usual_histories_are_shuffled_once(spark, monkeypatch):
    """No block of a usual history is made: the block table is empty, and the rows go by history alone."""
    f = _fills(spark, 3)
    plan = fe.history_features(f)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" in plan                                     # rows without blocks stay without offsets
    assert fe.long_histories(f.withColumn("_hb", fe._history_bucket())).count() == 0
    monkeypatch.setattr(fe, "LONG_HISTORY_ROWS", 1)
    assert fe.long_histories(f.withColumn("_hb", fe._history_bucket())).count() > 0


def test_stored_fills_hold_no_column_twice(spark, sf_dir):
    from ledger_spark.plans import research_queries as rq
    from ledger_spark.sources import derive
    got, want = rq.fills(spark, sf_dir), derive.fills(spark, sf_dir)
    assert not {"billing_id", "drug_name", "ndc"} & set(rq.STORED_FILL_COLUMNS)
    cols = [c for c in want.columns if c in got.columns]
    assert {"billing_id", "drug_name", "ndc"} <= set(cols)
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0 and got.count() == want.count()


def test_blocked_ranks_equal_plain_ones(spark, sf_dir, monkeypatch):
    from ledger_spark.sources import derive
    whole = derive.fills(spark, sf_dir)
    assert derive._long_patients(spark, sf_dir) == []
    assert "_blk" not in whole._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(derive, "LONG_HISTORY_ROWS", 1)
    blocked = derive.fills(spark, sf_dir)
    assert "_blk" in blocked._jdf.queryExecution().optimizedPlan().toString()
    assert blocked.exceptAll(whole).count() == 0 and blocked.count() == whole.count() > 5000


def test_shared_tables_are_packed_with_zstd(spark, sf_dir):
    from ledger_spark.plans import research_queries as rq
    for shared in (rq.fills(spark, sf_dir), rq.candidate_features(spark, sf_dir)):
        assert shared.inputFiles() and all(f.endswith(".zstd.parquet") for f in shared.inputFiles())
