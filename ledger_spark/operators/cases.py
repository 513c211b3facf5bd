"""Follow-up case workflow as a fold over ordered events.

Per prescription number, events are ordered by ``(ts, event_id)``:

* an ineligible prediction (no probability, or days of supply out of every band) is
  never stored and touches no case;
* a positive prediction opens a case, or refreshes the open one;
* a negative prediction never touches a case;
* a resolution closes the open case (*effective*) or is a conflict;
* an activity is accepted only while a case is open.

The state is "the last positive-prediction-or-resolution before this event":
open iff it was a positive prediction.  ``blocked_running`` computes that
last-relevant-event and the running count of effective resolutions in hour
blocks, so a prescription with a huge event history is never ordered in one
task.  A case is then ``(rx, number of effective resolutions before it)`` and
all case attributes are a ``groupBy`` with ``min_by`` / ``max_by``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_spark.functions.rules import LOCKED_THRESHOLD, priority_band, priority_rank
from ledger_spark.operators.scan import blocked_running

ORDER = ("ts", "event_id")
PRIORITIES = ("low", "medium", "high", "urgent", "urgent_overdue")
CASE_STATUSES = ("open", "resolved")


@dataclass(frozen=True)
class Workflow:
    predictions: DataFrame
    cases: DataFrame
    activities: DataFrame
    resolutions: DataFrame


def _id(prefix: str, *cols: str | Column) -> Column:
    """Deterministic identifier (hex SHA-256) instead of a random UUID."""
    parts = [F.lit(prefix)] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                               for c in cols]
    return F.sha2(F.concat_ws("|", *parts), 256)


def eligible_prediction() -> Column:
    """A prediction that may be stored: it has a probability and its days of supply lie in a priority band."""
    return ((F.col("kind") == "predict") & F.col("renewal_probability").isNotNull()
            & priority_band(F.col("days_until_supply_end")).isNotNull())


def fold_events(events: DataFrame, threshold: float = LOCKED_THRESHOLD) -> DataFrame:
    """Annotate every event with state: effective / open-at-event / case sequence number."""
    # blocks are hours: monotone in (ts, event_id), and a busy prescription's
    # events spread over many of them
    ev = events.withColumn("_blk", F.date_trunc("hour", F.col("ts")))
    positive = eligible_prediction() & (F.col("renewal_probability") >= F.lit(threshold))
    ev = ev.withColumn("positive", F.coalesce(positive, F.lit(False)))
    relevant_kind = F.when(F.col("positive"), "predict").when(F.col("kind") == "resolve", "resolve")
    ev = ev.withColumn("_rel", relevant_kind)
    s1 = blocked_running(ev, ["rx_number"], "_blk", list(ORDER), last_before={"_prev_rel": "_rel"})
    open_before = F.coalesce(F.col("_prev_rel") == "predict", F.lit(False))
    s1 = s1.withColumn("case_open_before", open_before) \
           .withColumn("effective", (F.col("kind") == "resolve") & open_before)
    eff = F.when(F.col("effective"), 1).otherwise(0)
    s2 = blocked_running(s1, ["rx_number"], "_blk", list(ORDER), sums={"_eff_upto": eff})
    return s2.withColumn("case_seq", (F.col("_eff_upto") - eff).cast("long")) \
             .drop("_eff_upto", "_rel", "_prev_rel", "_blk")


def build_workflow(events: DataFrame, threshold: float = LOCKED_THRESHOLD) -> Workflow:
    folded = fold_events(events, threshold)
    preds = folded.filter(eligible_prediction())
    predictions = preds.select(                                        # N1
        _id("prediction", "event_id").alias("prediction_id"),
        "rx_number", F.col("ts").alias("predicted_at"),
        F.col("days_until_supply_end").cast("int").alias("days_until_supply_end"),
        "renewal_probability",
        F.lit(threshold).alias("threshold"),
        F.col("positive").cast("int").alias("prediction"),
        priority_band(F.col("days_until_supply_end")).alias("priority"),
        "case_seq", "event_id",
    )
    order = F.struct(*ORDER)
    pos = preds.filter("positive").withColumn("_pid", _id("prediction", "event_id"))
    opened = pos.groupBy("rx_number", "case_seq").agg(                 # N2
        F.min("ts").alias("opened_at"),
        F.max("ts").alias("last_evaluated_at"),
        F.min_by("_pid", order).alias("initial_prediction_id"),
        F.max_by("_pid", order).alias("latest_prediction_id"),
        F.max_by("renewal_probability", order).alias("latest_renewal_probability"),
        F.max_by("days_until_supply_end", order).cast("int").alias("latest_days_until_supply_end"),
        F.max_by(priority_band(F.col("days_until_supply_end")), order).alias("priority"),
        F.count(F.lit(1)).alias("positive_predictions"),
    )
    closing = folded.filter("effective").select(
        "rx_number", "case_seq", F.col("ts").alias("resolved_at"),
        F.col("event_id").alias("_resolve_event"))
    cases = opened.join(closing, ["rx_number", "case_seq"], "left").select(
        _id("case", "rx_number", "case_seq").alias("case_id"),
        "rx_number", "case_seq",
        F.when(F.col("resolved_at").isNull(), "open").otherwise("resolved").alias("status"),
        "priority", "latest_renewal_probability", "latest_days_until_supply_end",
        "opened_at", "last_evaluated_at", "resolved_at",
        "initial_prediction_id", "latest_prediction_id", "positive_predictions",
    )
    def case_of() -> Column:
        return _id("case", "rx_number", "case_seq")
    activities = folded.filter(F.col("kind") == "activity").select(   # N6
        _id("activity", "event_id").alias("activity_id"),
        F.when(F.col("case_open_before"), case_of()).alias("case_id"),
        "rx_number", F.col("ts").alias("performed_at"), "event_id",
        F.when(F.col("case_open_before"), "accepted").otherwise("conflict").alias("outcome"),
    )
    resolutions = folded.filter(F.col("kind") == "resolve").select(   # N8
        _id("resolution", "event_id").alias("resolution_id"),
        F.when(F.col("effective"), case_of()).alias("case_id"),
        "rx_number", F.col("ts").alias("resolved_at"), "event_id",
        F.when(F.col("effective"), "resolved").otherwise("conflict").alias("outcome"),
    )
    return Workflow(predictions, cases, activities, resolutions)


def work_queue(cases: DataFrame, status: str | None = "open", priority: str | None = None,
               limit: int | None = None) -> DataFrame:
    """Filter and order: urgency rank, days left asc, probability desc, opened asc."""
    q = cases
    if status is not None:
        q = q.filter(F.col("status") == status)
    if priority is not None:
        q = q.filter(F.col("priority") == priority)
    q = q.withColumn("urgency_rank", priority_rank(F.col("priority"))).orderBy(
        "urgency_rank", F.col("latest_days_until_supply_end").asc(),
        F.col("latest_renewal_probability").desc(), F.col("opened_at").asc(), "case_id")
    return q.limit(limit) if limit else q


def case_lookup(cases: DataFrame, case_id: str) -> DataFrame:
    """Point lookup by id (N5); an empty result is the not-found answer."""
    return cases.filter(F.col("case_id") == F.lit(case_id))


def case_activities(activities: DataFrame, case_id: str) -> DataFrame:
    """Accepted activities of one case by time."""
    return (activities.filter((F.col("case_id") == F.lit(case_id)) & (F.col("outcome") == "accepted"))
            .orderBy("performed_at", "event_id"))


def open_case_violations(cases: DataFrame) -> DataFrame:
    """Prescriptions with more than one open case (N3); expected empty."""
    return (cases.filter(F.col("status") == "open").groupBy("rx_number")
            .agg(F.count(F.lit(1)).alias("open_cases")).filter(F.col("open_cases") > 1))


def constraint_issues(wf: Workflow) -> DataFrame:
    """Enum, range and foreign-key checks as (check, violations) rows."""
    p, c, a, r = wf.predictions, wf.cases, wf.activities, wf.resolutions
    checks = [
        p.agg(F.count_if(~F.col("prediction").isin(0, 1)).alias("v")).select(
            F.lit("prediction_in_0_1").alias("check"), "v"),
        p.agg(F.count_if(~F.col("threshold").between(0, 1)).alias("v")).select(
            F.lit("threshold_in_0_1").alias("check"), "v"),
        p.agg(F.count_if(~F.col("priority").isin(*PRIORITIES) | F.col("priority").isNull()).alias("v"))
        .select(F.lit("prediction_priority_enum").alias("check"), "v"),
        c.agg(F.count_if(~F.col("status").isin(*CASE_STATUSES)).alias("v")).select(
            F.lit("case_status_enum").alias("check"), "v"),
        c.join(p.select(F.col("prediction_id").alias("initial_prediction_id")),
               "initial_prediction_id", "left_anti").agg(F.count(F.lit(1)).alias("v"))
        .select(F.lit("case_initial_prediction_fk").alias("check"), "v"),
        c.join(p.select(F.col("prediction_id").alias("latest_prediction_id")),
               "latest_prediction_id", "left_anti").agg(F.count(F.lit(1)).alias("v"))
        .select(F.lit("case_latest_prediction_fk").alias("check"), "v"),
        a.filter(F.col("case_id").isNotNull()).join(c.select("case_id"), "case_id", "left_anti")
        .agg(F.count(F.lit(1)).alias("v")).select(F.lit("activity_case_fk").alias("check"), "v"),
        r.filter(F.col("case_id").isNotNull()).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count_if(F.col("n") > 1).alias("v"))
        .select(F.lit("one_resolution_per_case").alias("check"), "v"),
    ]
    out = checks[0]
    for ch in checks[1:]:
        out = out.unionByName(ch)
    return out.withColumnRenamed("v", "violations")
