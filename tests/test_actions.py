"""Typed actions against case intervals: borders, refusals, planted conflicts, stored tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledger_spark.operators import actions as ac
from ledger_spark.operators import cases as cs

EVENTS = ("event_id long, ts timestamp_ntz, rx_number string, kind string, renewal_probability double, "
          "days_until_supply_end int, action_type string, note string, performed_by string")


def at(minute):
    return dt.datetime(2024, 5, 6, 7, 0) + dt.timedelta(minutes=minute)


def predict(i, minute, rx, p=0.9, days=3):
    return (i, at(minute), rx, "predict", p, days, None, None, None)


def act(i, minute, rx, kind, what, note=None):
    return (i, at(minute), rx, kind, None, None, what, note, "staff")


def test_outcomes_at_the_borders_of_a_case(spark):
    rows = [
        act(1, 0, "A", "activity", "fax_sent"),                          # before any case
        predict(2, 1, "A"), act(3, 1, "A", "activity", "fax_sent"),      # same minute, after the opening event
        act(4, 2, "A", "activity", "pigeon_sent"), act(5, 3, "A", "resolve", "other", "  \n"),
        act(6, 4, "A", "resolve", "lost", "x"), act(7, 5, "A", "activity", "other"),
        act(8, 6, "A", "resolve", "other", "moved"), act(9, 6, "A", "activity", "fax_sent"),    # after the closing event
        act(10, 7, "A", "resolve", "dose_changed"), predict(11, 8, "A"), act(12, 9, "A", "resolve", "other"),
        act(13, 10, "B", "activity", "message_sent"), act(14, 10, None, "activity", "message_sent"),
    ]
    wf = ac.typed_workflow(spark.createDataFrame(rows, EVENTS))
    got = {r.event_id: (r.outcome, r.case_id is not None) for r in wf.actions.collect()}
    assert got == {1: ("conflict", False), 3: ("accepted", True), 4: ("invalid_type", False), 5: ("note_required", False),
                   6: ("invalid_type", False), 7: ("accepted", True), 8: ("resolved", True), 9: ("conflict", False),
                   10: ("conflict", False), 12: ("note_required", False), 13: ("conflict", False), 14: ("conflict", False)}
    cases = sorted(wf.cases.collect(), key=lambda r: r.case_seq)
    assert [(c.status, c.opened_at, c.resolved_at) for c in cases] == [("resolved", at(1), at(6)), ("open", at(8), None)]
    assert {r.case_id for r in wf.actions.collect() if r.event_id in (3, 7, 8)} == {cases[0].case_id}
    assert ac.resolution_table(wf.actions).collect()[0].resolution_note == "moved"
    assert {r.activity_type for r in ac.activity_table(wf.actions).collect()} == {"fax_sent", "other"}
    assert {(r.kind, r.outcome): r.actions for r in ac.action_issues(wf.actions).collect()}[("resolve", "note_required")] == 2


def test_ineligible_predictions_open_no_case(spark):
    rows = [predict(1, 0, "A", days=40), predict(2, 1, "A", p=None), predict(3, 2, "A", days=-8), predict(4, 3, "A", p=0.1),
            predict(5, 4, "B", days=None), predict(6, 5, "B", days=-7)]
    events = spark.createDataFrame(rows, EVENTS)
    wf = ac.typed_workflow(events)
    assert {(r.event_id, r.code) for r in wf.refused.collect()} == {
        (1, "not_eligible"), (2, "missing_output"), (3, "not_eligible"), (5, "not_eligible")}
    assert [(r.rx_number, r.priority) for r in wf.cases.collect()] == [("B", "urgent_overdue")]
    plain = cs.build_workflow(events)
    assert {r.event_id for r in plain.predictions.collect()} == {4, 6} and plain.cases.count() == 1


def test_interval_join_matches_a_plain_search(spark):
    rng = random.Random(6)
    spans, points, n = [], [], 0
    for key in ("hot", "b", "c"):
        when = 0
        for _ in range(60 if key == "hot" else 5):
            start = when + rng.randrange(0, 40)
            when = start + rng.randrange(1, 300)
            spans.append((key, at(start), n, at(when), n + 1, f"{key}{n}"))
            n += 2
        spans.append((key, at(when + 9), n, None, None, f"{key}{n}"))
        n += 2
    for i in range(800):
        points.append((rng.choice(["hot", "hot", "b", "c", "none", None]), None if i % 90 == 0 else at(rng.randrange(0, 12000)), i * 3 % 157))
    intervals = spark.createDataFrame(spans, "k string, a timestamp_ntz, ai long, z timestamp_ntz, zi long, v string")
    asked = spark.createDataFrame(points, "k string, t timestamp_ntz, i long")
    got = ac.interval_asof(asked, intervals, "k", ("t", "i"), ("a", "ai"), ("z", "zi"), "v", "hit", F.date_trunc("hour", F.col("_io_0")))
    want = [(k, t, i, next((v for kk, a, ai, z, zi, v in spans if kk == k and t is not None and (a, ai) <= (t, i)
                            and (z is None or (t, i) < (z, zi))), None)) for k, t, i in points]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert sum(w[3] is not None for w in want) > 300


def test_stored_predictions_are_the_eligible_ones(spark):
    schema = ("rx_number string, eligible boolean, expected_supply_end_date date, days_until_supply_end int, renewal_probability double, "
              "threshold double, prediction int, priority string")
    day = dt.date(2024, 5, 6)
    rows = [("A", True, day, 3, 0.8, 0.5, 1, "high"), ("B", True, day, 9, 0.2, 0.5, 0, "low"), ("C", False, day, 40, None, 0.5, None, None),
            ("D", None, None, None, None, None, None, None)]
    kept = ac.prediction_table(spark.createDataFrame(rows, schema), F.lit(at(0)), "v1", "r1").collect()
    assert sorted((r.rx_number, r.prediction, r.model_version, r.model_run_id) for r in kept) == [("A", 1, "v1", "r1"), ("B", 0, "v1", "r1")]
    broken = spark.createDataFrame([("E", True, day, 3, None, 0.5, 1, "high")], schema)
    with pytest.raises(Exception, match="E"):
        ac.prediction_table(broken, F.lit(at(0)), "v1", "r1").collect()
