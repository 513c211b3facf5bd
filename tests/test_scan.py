import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledger_spark.operators.scan import blocked_running


def _rows(seed, n):
    rng = random.Random(seed)
    ids = rng.sample(range(1000), n)   # unique ids: the order is total
    return [(rng.choice("ab"), rng.randint(0, 5), f"id{i:03d}", rng.randint(-3, 9),
             rng.choice([None, "x", "y"])) for i in ids]


@settings(max_examples=4, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 60))
def test_blocked_running_equals_plain_windows(spark, seed, n):
    df = spark.createDataFrame(_rows(seed, n), "g string, day int, id string, v int, tag string")
    got = blocked_running(df, ["g"], "day", ["day", "id"], position="pos", sums={"cv": F.col("v")},
                          previous={"pv": "v"}, last_before={"lt": "tag"})
    w = Window.partitionBy("g").orderBy("day", "id")
    ref = df.select("*", (F.row_number().over(w) - 1).alias("pos"),
                    F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cv"),
                    F.lag("v").over(w).alias("pv"),
                    F.last("tag", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("lt"))
    cols = ["g", "day", "id", "v", "tag", "pos", "cv", "pv", "lt"]
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == \
        sorted(map(tuple, ref.select(*cols).collect()), key=str)


def test_reverse_walk_gives_lead(spark):
    df = spark.createDataFrame(_rows(7, 40), "g string, day int, id string, v int, tag string")
    got = blocked_running(df, ["g"], "day", ["day", "id"], previous={"nv": "v"}, reverse=True)
    w = Window.partitionBy("g").orderBy("day", "id")
    ref = df.select("*", F.lead("v").over(w).alias("nv"))
    assert sorted(got.select("g", "day", "id", "nv").collect()) == sorted(ref.select("g", "day", "id", "nv").collect())
