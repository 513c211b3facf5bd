"""Follow-up cases as a Structured Streaming fold.

Events arrive as a stream, in any order (``run_case_stream``).  Each micro-batch
writes the events it brings that are not stored yet, then folds the
prescriptions of those events anew, from all their stored events, with the batch
fold (``operators.cases``); a replay is a no-op, a late event takes its place in
time.  An event is known by ``(rx_number, ts, event_id)``; one without an id is
never taken for a replay.  Each micro-batch has folders of its own, which a
retry overwrites.

``case_updates`` is the cheaper fold with ``applyInPandasWithState`` for events
that reach each prescription in time order: its state holds the open case and
the last applied ``(ts, event_id)``, and what is not above that counts as a replay.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledger_spark.functions.rules import LOCKED_THRESHOLD, PRIORITY_BANDS
from ledger_spark.operators.cases import build_workflow
from ledger_spark.session import ensure_checkpoint_dir
from ledger_spark.sources import derive

CASE_SCHEMA = (
    "case_id string, rx_number string, case_seq long, status string, priority string, "
    "latest_renewal_probability double, latest_days_until_supply_end int, opened_at timestamp_ntz, "
    "last_evaluated_at timestamp_ntz, resolved_at timestamp_ntz, initial_prediction_id string, "
    "latest_prediction_id string, positive_predictions long, update_seq long"
)
EVENT_SCHEMA = (
    "event_id long, ts timestamp_ntz, rx_number string, kind string, renewal_probability double, "
    "days_until_supply_end int"
)
EVENT_KEY = ("rx_number", "ts", "event_id")
STATE_SCHEMA = (
    "case_seq long, is_open boolean, priority string, prob double, days int, opened_at timestamp_ntz, "
    "last_at timestamp_ntz, initial_id string, latest_id string, n long, "
    "last_ts timestamp_ntz, last_event long, applied long"
)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _band(days: int) -> str | None:
    for name, lo, hi in PRIORITY_BANDS:
        if lo <= days <= hi:
            return name
    return None


def _fold_group(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rx = key[0]
    if state.exists:
        (case_seq, is_open, priority, prob, days, opened_at, last_at, initial_id, latest_id, n,
         last_ts, last_event, applied) = state.get
    else:
        case_seq, is_open, priority, prob, days = 0, False, None, None, None
        opened_at = last_at = initial_id = latest_id = None
        n, last_ts, last_event, applied = 0, None, None, 0
    events = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "event_id"], kind="mergesort")
    touched: dict[int, dict] = {}

    def snapshot(resolved_at=None):
        return {
            "case_id": _sha(f"case|{rx}|{case_seq}"), "rx_number": rx, "case_seq": case_seq,
            "status": "resolved" if resolved_at is not None else "open", "priority": priority,
            "latest_renewal_probability": prob, "latest_days_until_supply_end": days,
            "opened_at": opened_at, "last_evaluated_at": last_at, "resolved_at": resolved_at,
            "initial_prediction_id": initial_id, "latest_prediction_id": latest_id,
            "positive_predictions": n, "update_seq": applied,
        }

    for ev in events.itertuples(index=False):
        if last_ts is not None and (ev.ts, ev.event_id) <= (last_ts, last_event):
            continue   # already applied (replay)
        last_ts, last_event, applied = ev.ts, int(ev.event_id), applied + 1
        if (ev.kind == "predict" and ev.renewal_probability >= LOCKED_THRESHOLD and pd.notna(ev.days_until_supply_end)
                and _band(int(ev.days_until_supply_end))):
            pid = _sha(f"prediction|{int(ev.event_id)}")
            if not is_open:
                is_open, opened_at, initial_id, n = True, ev.ts, pid, 0
            latest_id, prob, days = pid, float(ev.renewal_probability), int(ev.days_until_supply_end)
            priority, last_at, n = _band(days), ev.ts, n + 1
            touched[case_seq] = snapshot()
        elif ev.kind == "resolve" and is_open:
            touched[case_seq] = snapshot(resolved_at=ev.ts)
            is_open, case_seq = False, case_seq + 1
    state.update((case_seq, is_open, priority, prob, days, opened_at, last_at, initial_id, latest_id,
                  n, last_ts, last_event, applied))
    if touched:
        yield pd.DataFrame(list(touched.values()))


def case_updates(events: DataFrame) -> DataFrame:
    """Streaming (or batch) workflow events in time order per prescription -> case rows updated per micro-batch."""
    return events.groupBy("rx_number").applyInPandasWithState(
        _fold_group, CASE_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout)


def workflow_event_stream(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    """``events`` read as a file stream and mapped like ``derive.workflow_events``."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{sf_dir}/events*.parquet")
    return derive.workflow_events_from(raw)


def _refold(batch: DataFrame, batch_id: int, root: str) -> None:
    """Store the new events of a micro-batch and the cases of their prescriptions."""
    spark = batch.sparkSession
    stored = spark.read.schema(f"{EVENT_SCHEMA}, batch long").parquet(f"{root}/events")
    once = batch.where("event_id IS NOT NULL").dropDuplicates(list(EVENT_KEY)).unionByName(batch.where("event_id IS NULL"))
    (once.join(stored.where(F.col("batch") < batch_id), list(EVENT_KEY), "left_anti").select(*stored.drop("batch").columns)
     .write.mode("overwrite").parquet(f"{root}/events/batch={batch_id}"))
    stored = spark.read.schema(f"{EVENT_SCHEMA}, batch long").parquet(f"{root}/events").where(F.col("batch") <= batch_id)
    touched = stored.where(F.col("batch") == batch_id).select("rx_number").distinct()
    cases = build_workflow(stored.drop("batch").join(touched, "rx_number", "left_semi")).cases
    cases.write.mode("overwrite").parquet(f"{root}/cases/batch={batch_id}")


def run_case_stream(spark: SparkSession, sf_dir: str, out_dir: str | None = None) -> DataFrame:
    """Run the stream to completion (available-now) into Parquet; return the latest case rows."""
    root = out_dir or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/cases-{uuid.uuid4().hex[:8]}"
    case_schema = CASE_SCHEMA.removesuffix(", update_seq long")
    for name, schema in (("events", EVENT_SCHEMA), ("cases", case_schema)):     # so that both folders can be read
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/{name}/batch=-1")
    query = (workflow_event_stream(spark, sf_dir).writeStream
             .foreachBatch(lambda df, batch_id: _refold(df, batch_id, root))
             .option("checkpointLocation", f"{root}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    cases = spark.read.schema(f"{case_schema}, batch long").parquet(f"{root}/cases")
    last = cases.groupBy("rx_number").agg(F.max("batch").alias("batch"))
    return cases.join(last, ["rx_number", "batch"], "left_semi").drop("batch")


def latest_cases(updates: DataFrame) -> DataFrame:
    """Last emitted row per case (highest update sequence of its prescription)."""
    cols = [c for c in updates.columns if c not in ("case_id", "update_seq")]
    best = updates.groupBy("case_id").agg(
        F.max_by(F.struct(*cols), F.col("update_seq")).alias("s"))
    return best.select("case_id", "s.*")
