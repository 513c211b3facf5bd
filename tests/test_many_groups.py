"""Many copies are ranked without a broadcast: neither the copies' donors nor their block tables go to the driver."""

import re

from pyspark.sql import functions as F
from test_permutation import rows_of

from ledger_spark.operators import metrics as me
from ledger_spark.operators import models as mo
from ledger_spark.operators.scan import blocked_running


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_donors_are_merged_not_broadcast(spark, tmp_path):
    data = rows_of(spark)
    data.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))           # its size estimate is far below the broadcast limit
    plan = _plan(mo.permutation_importance(mo.fit(mo.TUNED_SPECS[0], data), stored, 3))
    assert re.search(r"SortMergeJoin \[_dpos#\d+L?\]", plan) and not re.search(r"BroadcastHashJoin \[_dpos", plan)
    assert not re.search(r"BroadcastHashJoin \[_g#", plan)


def test_group_sums_and_merged_blocks_equal_the_broadcast_ones(spark):
    df = spark.range(300).select((F.col("id") % 7).alias("k"), (F.col("id") * 37 % 101).alias("v"), (F.col("id") % 11).alias("x"))
    found = [sorted(blocked_running(df.withColumn("b", F.floor(F.col("v") / 10)), ["k"], "b", ["v", "x"], sums={"s": F.col("x")},
                                    sum_totals={"all": "s"}, reverse=True, many_groups=many).collect()) for many in (False, True)]
    assert found[0] == found[1] and len(found[0]) == 300
    whole = {r.k: r.n for r in df.groupBy("k").agg(F.sum("x").alias("n")).collect()}
    assert all(r["all"] == whole[r.k] for r in found[0])
    scored = df.select("k", (F.col("x") % 2).alias("label"), (F.col("v") / 101).alias("score"))
    one, two = (sorted((r.k, round(r.pr_auc, 12), round(r.roc_auc, 12)) for r in me.ranking_metrics(
        scored, ["k"], many_groups=many).collect()) for many in (False, True))
    assert one == two and len(one) == 7
