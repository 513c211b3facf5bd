"""Typed activities and resolutions against the open intervals of cases.

A resolution counts only if its type is known and, for ``other``, it has a
note; refused ones leave the case open.  The cases that follow are intervals
[opening event, closing event) of a prescription, and every action is joined
to the interval it falls into: an as-of join, done as a blocked merge of
interval starts and actions, so that neither a busy prescription nor a busy
hour is ordered in one task.  Nothing is dropped: an action that is not
accepted is returned with the reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_spark.functions.rules import LOCKED_THRESHOLD
from ledger_spark.operators import cases as cs
from ledger_spark.operators.scan import blocked_running

# The kinds of activity and of resolution.
ACTIVITY_TYPES = (
    "called_prescriber", "left_voicemail", "fax_sent", "message_sent",
    "spoke_with_prescriber", "patient_contacted", "other",
)
RESOLUTION_TYPES = (
    "new_prescription_received", "medication_discontinued", "dose_changed",
    "medication_changed", "patient_changed_pharmacy", "patient_unreachable",
    "prescriber_no_response", "other",
)
OUTCOMES = ("accepted", "resolved", "invalid_type", "conflict", "note_required")


def blank(c: Column) -> Column:
    return c.isNull() | (F.btrim(c, F.lit(" \t\n\x0b\x0c\r")) == "")


def interval_asof(points: DataFrame, intervals: DataFrame, key: str, order: tuple[str, ...], start: tuple[str, ...],
                  end: tuple[str, ...], value: str, out: str, block: Column) -> DataFrame:
    """The points with ``out``: the ``value`` of the interval of their ``key`` that they lie in, else null.

    Intervals of one key do not overlap; they run from ``start`` (inclusive) to ``end`` (exclusive; null: no
    end), tuples of columns that compare like ``order`` of the points.  ``block`` is a non-decreasing
    expression along ``order``.  A point looks at the last start before or at it, so one pass over both sides
    in order is enough: no pairs of points and intervals are made.  Points without a key or time lie in none.
    """
    names = [f"_io_{i}" for i in range(len(order))]
    starts = intervals.select(F.col(key), *[F.col(s).alias(n) for s, n in zip(start, names)], F.lit(0).alias("_io_side"),
                              F.struct(F.col(value).alias("value"), F.struct(*[F.col(e) for e in end]).alias("end"),
                                       F.col(end[0]).isNull().alias("endless")).alias("_io_span"),
                              F.lit(None).cast(points.schema).alias("_io_row"))
    spans = starts.schema["_io_span"].dataType
    asked = points.select(F.col(key), *[F.col(o).alias(n) for o, n in zip(order, names)], F.lit(1).alias("_io_side"),
                          F.lit(None).cast(spans).alias("_io_span"), F.struct(*[F.col(c) for c in points.columns]).alias("_io_row"))
    placed = F.col(key).isNotNull()
    for n in names:
        placed = placed & F.col(n).isNotNull()
    both = starts.unionByName(asked.where(placed)).withColumn("_io_block", block)
    seen = blocked_running(both, [key], "_io_block", [*names, "_io_side"], last_before={"_io_last": "_io_span"})
    inside = F.col("_io_last").isNotNull() & (F.col("_io_last.endless") | (F.struct(*names) < F.col("_io_last.end")))
    found = seen.where("_io_side = 1").select("_io_row.*", F.when(inside, F.col("_io_last.value")).alias(out))
    lost = points.where(~_all_set(points, key, order))
    return found.unionByName(lost.withColumn(out, F.lit(None).cast(found.schema[out].dataType)))


def _all_set(points: DataFrame, key: str, order: tuple[str, ...]) -> Column:
    ok = F.col(key).isNotNull()
    for o in order:
        ok = ok & F.col(o).isNotNull()
    return ok


def prediction_issues(events: DataFrame) -> DataFrame:
    """Predictions that are refused, with the reason: out of every band, or without a probability."""
    bad = events.where((F.col("kind") == "predict") & ~F.coalesce(cs.eligible_prediction(), F.lit(False)))
    return bad.select("event_id", "rx_number", F.when(F.col("renewal_probability").isNull(), "missing_output")
                      .otherwise("not_eligible").alias("code"))


@dataclass(frozen=True)
class TypedWorkflow:
    cases: DataFrame
    actions: DataFrame           # every activity and resolution with its outcome
    refused: DataFrame           # predictions that were not stored


def typed_workflow(events: DataFrame, threshold: float = LOCKED_THRESHOLD) -> TypedWorkflow:
    """Cases under typed resolutions, and every action joined to them.

    ``events``: event_id, ts, rx_number, kind (predict, resolve, activity), renewal_probability,
    days_until_supply_end, action_type, note, performed_by.
    """
    kind, noted = F.col("kind"), F.col("action_type") != "other"
    known = F.coalesce(F.when(kind == "activity", F.col("action_type").isin(*ACTIVITY_TYPES))
                       .when(kind == "resolve", F.col("action_type").isin(*RESOLUTION_TYPES)), F.lit(False))
    complete = F.when(kind == "resolve", noted | ~blank(F.col("note"))).otherwise(True)
    folded = events.where(cs.eligible_prediction() | ((kind == "resolve") & known & complete))
    wf = cs.build_workflow(folded.select("event_id", "ts", "rx_number", "kind", "renewal_probability", "days_until_supply_end"), threshold)
    closers = wf.resolutions.where("outcome = 'resolved'").select("case_id", F.col("event_id").alias("closed_by"))
    openers = wf.predictions.select(F.col("prediction_id").alias("initial_prediction_id"), F.col("event_id").alias("opened_by"))
    spans = wf.cases.join(closers, "case_id", "left").join(openers, "initial_prediction_id").select(
        "case_id", "rx_number", "opened_at", "opened_by", "resolved_at", "closed_by")
    # a resolution closes the case that is open before it: its own event is still inside
    spans = spans.withColumn("closed_by", F.col("closed_by") + 1)
    actions = events.where(kind.isin("activity", "resolve")).select(
        "event_id", "ts", "rx_number", "kind", "action_type", "note", "performed_by",
        known.alias("known"), complete.alias("complete"))
    joined = interval_asof(actions, spans, "rx_number", ("ts", "event_id"), ("opened_at", "opened_by"),
                           ("resolved_at", "closed_by"), "case_id", "open_case", F.date_trunc("hour", F.col("_io_0")))
    outcome = (F.when(~F.col("known"), "invalid_type").when(F.col("open_case").isNull(), "conflict")
               .when(~F.col("complete"), "note_required")
               .otherwise(F.when(F.col("kind") == "resolve", "resolved").otherwise("accepted")))
    done = joined.withColumn("outcome", outcome)
    return TypedWorkflow(wf.cases, done.select(
        "event_id", "rx_number", "kind", "action_type", "note", "performed_by", F.col("ts").alias("performed_at"),
        F.when(F.col("outcome").isin("accepted", "resolved"), F.col("open_case")).alias("case_id"), "outcome"),
        prediction_issues(events))


def action_issues(actions: DataFrame) -> DataFrame:
    """(kind, outcome, actions): how many were accepted, and why the others were not."""
    return actions.groupBy("kind", "outcome").agg(F.count(F.lit(1)).alias("actions"))


def activity_table(actions: DataFrame) -> DataFrame:
    """What the activities table stores of accepted activities, under deterministic ids."""
    return actions.where("kind = 'activity' AND outcome = 'accepted'").select(
        cs._id("activity", "event_id").alias("activity_id"), "case_id", F.col("action_type").alias("activity_type"),
        F.col("note").alias("activity_note"), "performed_at", "performed_by")


def resolution_table(actions: DataFrame) -> DataFrame:
    """What the resolutions table stores of effective resolutions (A8); one per case."""
    return actions.where("kind = 'resolve' AND outcome = 'resolved'").select(
        cs._id("resolution", "event_id").alias("resolution_id"), "case_id", F.col("action_type").alias("resolution_type"),
        F.col("note").alias("resolution_note"), F.col("performed_at").alias("resolved_at"))


def prediction_table(results: DataFrame, predicted_at: Column, model_version: str, model_run_id: str) -> DataFrame:
    """What the predictions table stores of a scored batch: eligible rows, with model version and run.

    An eligible row without its outputs raises when the table is written.
    """
    whole = F.col("renewal_probability").isNotNull() & F.col("prediction").isNotNull() & F.col("priority").isNotNull()
    kept = results.where(F.coalesce(F.col("eligible"), F.lit(False)))
    checked = F.when(whole, F.col("renewal_probability")).otherwise(
        F.raise_error(F.concat(F.lit("An eligible prediction has no outputs: "), F.coalesce("rx_number", F.lit("(no number)")))).cast("double"))
    return kept.select("rx_number", predicted_at.alias("predicted_at"), "expected_supply_end_date", "days_until_supply_end",
                       checked.alias("renewal_probability"), "threshold", "prediction", "priority",
                       F.lit(model_version).alias("model_version"), F.lit(model_run_id).alias("model_run_id"))
