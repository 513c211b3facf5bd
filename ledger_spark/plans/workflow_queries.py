"""Registered batch-scoring (M) and follow-up workflow (N) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledger_spark.functions.rules import PRIORITY_BANDS, priority_band_sql, priority_rank_sql
from ledger_spark.operators import actions as ac
from ledger_spark.operators import cases as cs
from ledger_spark.operators import scoring as sc
from ledger_spark.operators.propensity import propensity_sql, renewal_propensity
from ledger_spark.plans.eval_queries import LABEL, SPLIT_SQL
from ledger_spark.plans.linear_queries import LINEAR_SCORE_SQL, LINEAR_STATS_SQL, stored_linear
from ledger_spark.plans.oracle import CANDIDATE_FEATURES
from ledger_spark.plans.registry import register
from ledger_spark.plans.research_queries import LABEL_AFTER_DAYS, candidates, observations_sql
from ledger_spark.sources import derive

REQUEST_FEATURES = [f[0] for f in sc.REQUEST_FIELDS]


def requests(spark, sf_dir):
    """Score requests: every fill with its point-in-time features, batched by month.

    A batch runs on the last day of the observation month (its business date).
    """
    c = candidates(spark, sf_dir, LABEL_AFTER_DAYS)
    return c.select(
        F.last_day("observation_date").alias("batch_id"),
        F.col("prescription_id").alias("rx_number"), "fill_date",
        F.col("current_refills_remaining").cast("double").alias("current_refills_remaining"),
        *[F.col(n) for n in REQUEST_FEATURES[3:]],
    )


def score_requests(spark, sf_dir):
    return sc.score_batch(requests(spark, sf_dir), F.col("batch_id"), renewal_propensity)


def _m_sql(select: str, score: str = propensity_sql(), ctes: str = "", beside: str = "") -> str:
    checks = []
    for name, kind, lower, inclusive, upper in sc.REQUEST_FIELDS:
        if kind != "optional_float":
            checks.append((f"{name} IS NULL", sc.MISSING_MESSAGE[kind]))
        if kind == "str":
            checks.append((f"length({name}) < 1", sc.TOO_SHORT_MESSAGE))
        if kind == "int":
            checks.append((f"{name} <> floor({name})", sc.FRACTION_MESSAGE))
        if lower is not None:
            checks.append((f"{name} {'<' if inclusive else '<='} {lower}", sc._bound_message(lower, inclusive)))
        if upper is not None:
            checks.append((f"{name} > {upper}", f"Input should be less than or equal to {upper}"))
    err = "CASE " + " ".join(f"WHEN coalesce({c}, false) THEN 'Invalid {n}: {m}'"
                             for (c, m), n in zip(checks, _names(checks))) + " END"
    band = priority_band_sql("days")
    return observations_sql(LABEL_AFTER_DAYS, CANDIDATE_FEATURES + f"""
, req AS (SELECT last_day(observation_date) AS batch_id, * FROM requests)
{ctes}, v AS (SELECT *, {err} AS err,
               CAST(fill_date + CAST(current_days_supply AS INTEGER) AS DATE) AS supply_end,
               datediff('day', last_day(observation_date), fill_date + CAST(current_days_supply AS INTEGER)) AS days
        FROM req)
, e AS (SELECT *, current_refills_remaining = 0 AND ({band}) IS NOT NULL AS elig,
               {score} AS p FROM v{beside})
, scored AS (
  SELECT batch_id, rx_number,
         CASE WHEN err IS NOT NULL THEN 'error' WHEN elig THEN 'success' ELSE 'ineligible' END AS status,
         CASE WHEN err IS NULL THEN elig END AS eligible,
         CASE WHEN err IS NULL THEN supply_end END AS expected_supply_end_date,
         CASE WHEN err IS NULL THEN CAST(days AS INTEGER) END AS days_until_supply_end,
         CASE WHEN err IS NULL AND elig THEN p END AS renewal_probability,
         CASE WHEN err IS NULL THEN 0.5 END AS threshold,
         CASE WHEN err IS NULL AND elig THEN CAST(p >= 0.5 AS INTEGER) END AS prediction,
         CASE WHEN err IS NULL AND elig THEN {band} END AS priority,
         CASE WHEN err IS NOT NULL THEN NULL
              WHEN current_refills_remaining <> 0 THEN 'refills_remaining'
              WHEN ({band}) IS NULL AND days < -7 THEN 'manual_review'
              WHEN ({band}) IS NULL THEN 'not_in_prediction_window'
              WHEN p >= 0.5 THEN 'prescription_review' ELSE 'no_review' END AS review_status,
         CASE WHEN err IS NOT NULL THEN 'validation_error' END AS error_code,
         err AS message
  FROM e)
{select}""")


def _names(checks):
    # the field name is the first token of each condition
    return [c.split()[0].replace("length(", "").replace(")", "") for c, _ in checks]


@register("m_score_batch", _m_sql("SELECT * FROM scored"), ["renewal_probability", "threshold"],
          dates=("batch_id", "expected_supply_end_date"), nullable_ints=("days_until_supply_end", "prediction", "eligible"))
def m_score_batch(spark, sf_dir):
    """Validate, band, score and review every request of the monthly batches (M1-M5, M7)."""
    return score_requests(spark, sf_dir)


@register("m_batch_counters", _m_sql("""
SELECT batch_id, count(*) AS total_records, count(*) FILTER (WHERE status <> 'error') AS processed,
       count(*) FILTER (WHERE status = 'error') AS failed,
       count(*) FILTER (WHERE coalesce(eligible, false)) AS eligible_records,
       count(*) FILTER (WHERE prediction = 1) AS flagged_for_review
FROM scored GROUP BY batch_id"""), dates=("batch_id",))
def m_batch_counters(spark, sf_dir):
    """total / processed / failed / eligible / flagged per batch (M6)."""
    return sc.batch_counters(score_requests(spark, sf_dir), ["batch_id"])


def linear_scores(spark, sf_dir):
    """The monthly batches scored by the stored linear model, as one column expression (M5)."""
    model = stored_linear(spark, sf_dir, LABEL_AFTER_DAYS)
    return sc.score_batch(requests(spark, sf_dir), F.col("batch_id"), model.column)


@register("m_linear_batch", _m_sql(
    "SELECT * FROM scored", LINEAR_SCORE_SQL,
    f", split_obs AS (SELECT *, {SPLIT_SQL} AS split, {LABEL} AS label FROM observations)\n" + LINEAR_STATS_SQL, ", lin"),
    ["renewal_probability", "threshold"], dates=("batch_id", "expected_supply_end_date"),
    nullable_ints=("days_until_supply_end", "prediction", "eligible"))
def m_linear_batch(spark, sf_dir):
    """Every request of the monthly batches scored by the locked linear model in closed form."""
    return linear_scores(spark, sf_dir)


# ---------------------------------------------------------------- N workflow
_EVENTS_SQL = f"""
WITH ev AS (
  SELECT event_id, ts, 'RX-' || CAST(user_id AS VARCHAR) AS rx_number,
         CASE WHEN event_type = 'purchase' THEN 'resolve' WHEN event_type = 'signup' THEN 'activity'
              ELSE 'predict' END AS kind,
         CASE WHEN event_type NOT IN ('purchase', 'signup') THEN value / (value + 50.0) END AS renewal_probability,
         CASE WHEN event_type NOT IN ('purchase', 'signup') THEN CAST(10 - event_id % 18 AS INTEGER) END
           AS days_until_supply_end
  FROM events)
, ev1 AS (SELECT *, coalesce(kind = 'predict' AND renewal_probability >= 0.5, false) AS positive FROM ev)
, ev2 AS (
  SELECT *, last_value(CASE WHEN positive THEN 'predict' WHEN kind = 'resolve' THEN 'resolve' END IGNORE NULLS)
              OVER (PARTITION BY rx_number ORDER BY ts, event_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_rel
  FROM ev1)
, ev3 AS (SELECT *, coalesce(prev_rel = 'predict', false) AS case_open_before,
                 kind = 'resolve' AND coalesce(prev_rel = 'predict', false) AS effective FROM ev2)
, folded AS (
  SELECT *, CAST(coalesce(sum(CASE WHEN effective THEN 1 ELSE 0 END)
              OVER (PARTITION BY rx_number ORDER BY ts, event_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS case_seq
  FROM ev3)
, predictions AS (
  SELECT sha256('prediction|' || CAST(event_id AS VARCHAR)) AS prediction_id, rx_number, ts AS predicted_at,
         days_until_supply_end, renewal_probability, 0.5 AS threshold, CAST(positive AS INTEGER) AS prediction,
         {priority_band_sql('days_until_supply_end')} AS priority, case_seq, event_id
  FROM folded WHERE kind = 'predict')
, opened AS (
  SELECT rx_number, case_seq, min(predicted_at) AS opened_at, max(predicted_at) AS last_evaluated_at,
         arg_min(prediction_id, (predicted_at, event_id)) AS initial_prediction_id,
         arg_max(prediction_id, (predicted_at, event_id)) AS latest_prediction_id,
         arg_max(renewal_probability, (predicted_at, event_id)) AS latest_renewal_probability,
         arg_max(days_until_supply_end, (predicted_at, event_id)) AS latest_days_until_supply_end,
         arg_max(priority, (predicted_at, event_id)) AS priority,
         count(*) AS positive_predictions
  FROM predictions WHERE prediction = 1 GROUP BY rx_number, case_seq)
, closing AS (SELECT rx_number, case_seq, ts AS resolved_at FROM folded WHERE effective)
, cases AS (
  SELECT sha256('case|' || o.rx_number || '|' || CAST(o.case_seq AS VARCHAR)) AS case_id, o.rx_number, o.case_seq,
         CASE WHEN c.resolved_at IS NULL THEN 'open' ELSE 'resolved' END AS status,
         priority, latest_renewal_probability, latest_days_until_supply_end, opened_at, last_evaluated_at,
         c.resolved_at, initial_prediction_id, latest_prediction_id, positive_predictions
  FROM opened o LEFT JOIN closing c USING (rx_number, case_seq))
, activities AS (
  SELECT sha256('activity|' || CAST(event_id AS VARCHAR)) AS activity_id,
         CASE WHEN case_open_before THEN sha256('case|' || rx_number || '|' || CAST(case_seq AS VARCHAR)) END AS case_id,
         rx_number, ts AS performed_at, event_id,
         CASE WHEN case_open_before THEN 'accepted' ELSE 'conflict' END AS outcome
  FROM folded WHERE kind = 'activity')
, resolutions AS (
  SELECT sha256('resolution|' || CAST(event_id AS VARCHAR)) AS resolution_id,
         CASE WHEN effective THEN sha256('case|' || rx_number || '|' || CAST(case_seq AS VARCHAR)) END AS case_id,
         rx_number, ts AS resolved_at, event_id,
         CASE WHEN effective THEN 'resolved' ELSE 'conflict' END AS outcome
  FROM folded WHERE kind = 'resolve')
"""


def workflow(spark, sf_dir):
    return cs.build_workflow(derive.workflow_events(spark, sf_dir))


@register("n_prediction_records", _EVENTS_SQL + "SELECT * FROM predictions",
          ["renewal_probability", "threshold"], timestamps=("predicted_at",))
def n_prediction_records(spark, sf_dir):
    """Every eligible prediction appended with a deterministic id and its case number."""
    return workflow(spark, sf_dir).predictions


@register("n_cases", _EVENTS_SQL + "SELECT * FROM cases", ["latest_renewal_probability"],
          timestamps=("opened_at", "last_evaluated_at", "resolved_at"))
def n_cases(spark, sf_dir):
    """Cases opened, refreshed and resolved by the event fold."""
    return workflow(spark, sf_dir).cases


@register("n_workflow_summary", _EVENTS_SQL + """
SELECT (SELECT count(*) FROM predictions) AS predictions,
       (SELECT count(*) FROM predictions WHERE prediction = 1) AS positive_predictions,
       (SELECT count(*) FROM cases) AS cases,
       (SELECT count(*) FROM cases WHERE status = 'open') AS open_cases,
       (SELECT count(*) FROM resolutions) AS resolutions,
       (SELECT count(*) FROM resolutions WHERE outcome = 'conflict') AS conflicting_resolutions,
       (SELECT count(*) FROM activities) AS activities,
       (SELECT count(*) FROM activities WHERE outcome = 'conflict') AS conflicting_activities""")
def n_workflow_summary(spark, sf_dir):
    """Counts of predictions, cases, open cases, resolutions and activities with conflicts."""
    wf = workflow(spark, sf_dir)
    parts = [
        wf.predictions.agg(F.count(F.lit(1)).alias("predictions"),
                           F.count_if(F.col("prediction") == 1).alias("positive_predictions")),
        wf.cases.agg(F.count(F.lit(1)).alias("cases"),
                     F.count_if(F.col("status") == "open").alias("open_cases")),
        wf.resolutions.agg(F.count(F.lit(1)).alias("resolutions"),
                           F.count_if(F.col("outcome") == "conflict").alias("conflicting_resolutions")),
        wf.activities.agg(F.count(F.lit(1)).alias("activities"),
                          F.count_if(F.col("outcome") == "conflict").alias("conflicting_activities")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    names = ["predictions", "positive_predictions", "cases", "open_cases", "resolutions",
             "conflicting_resolutions", "activities", "conflicting_activities"]
    return out.agg(*[F.max(n).alias(n) for n in names])


@register("n_work_queue", _EVENTS_SQL + f"""
SELECT *, {priority_rank_sql('priority')} AS urgency_rank FROM cases WHERE status = 'open'
ORDER BY urgency_rank, latest_days_until_supply_end, latest_renewal_probability DESC, opened_at, case_id""",
          ["latest_renewal_probability"], timestamps=("opened_at", "last_evaluated_at", "resolved_at"))
def n_work_queue(spark, sf_dir):
    """Open cases in work order: urgency, days left, probability, age."""
    return cs.work_queue(workflow(spark, sf_dir).cases)


@register("n_activities", _EVENTS_SQL + "SELECT * FROM activities", timestamps=("performed_at",))
def n_activities(spark, sf_dir):
    """Activities accepted on an open case or rejected as conflicts."""
    return workflow(spark, sf_dir).activities


@register("n_resolutions", _EVENTS_SQL + "SELECT * FROM resolutions", timestamps=("resolved_at",))
def n_resolutions(spark, sf_dir):
    """Resolutions: effective on an open case, else conflicts."""
    return workflow(spark, sf_dir).resolutions


@register("n_open_case_check", _EVENTS_SQL + """
SELECT count(*) AS prescriptions_with_multiple_open_cases FROM (
  SELECT rx_number FROM cases WHERE status = 'open' GROUP BY rx_number HAVING count(*) > 1)""")
def n_open_case_check(spark, sf_dir):
    """At most one open case per prescription."""
    v = cs.open_case_violations(workflow(spark, sf_dir).cases)
    return v.agg(F.count(F.lit(1)).alias("prescriptions_with_multiple_open_cases"))


@register("n_constraint_issues", _EVENTS_SQL + f"""
SELECT * FROM (
  SELECT 'prediction_in_0_1' AS "check", count(*) FILTER (WHERE prediction NOT IN (0, 1)) AS violations FROM predictions
  UNION ALL SELECT 'threshold_in_0_1', count(*) FILTER (WHERE NOT threshold BETWEEN 0 AND 1) FROM predictions
  UNION ALL SELECT 'prediction_priority_enum', count(*) FILTER (WHERE priority IS NULL OR priority NOT IN
      ({', '.join(repr(b[0]) for b in PRIORITY_BANDS)})) FROM predictions
  UNION ALL SELECT 'case_status_enum', count(*) FILTER (WHERE status NOT IN ('open', 'resolved')) FROM cases
  UNION ALL SELECT 'case_initial_prediction_fk', count(*) FROM cases c
      WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.prediction_id = c.initial_prediction_id)
  UNION ALL SELECT 'case_latest_prediction_fk', count(*) FROM cases c
      WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.prediction_id = c.latest_prediction_id)
  UNION ALL SELECT 'activity_case_fk', count(*) FROM activities a
      WHERE a.case_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cases c WHERE c.case_id = a.case_id)
  UNION ALL SELECT 'one_resolution_per_case', count(*) FROM (
      SELECT case_id FROM resolutions WHERE case_id IS NOT NULL GROUP BY case_id HAVING count(*) > 1))""")
def n_constraint_issues(spark, sf_dir):
    """Enum, range and foreign-key checks on the workflow tables."""
    return cs.constraint_issues(workflow(spark, sf_dir))


@register("n_stream_cases", _EVENTS_SQL + "SELECT * FROM cases", ["latest_renewal_probability"],
          timestamps=("opened_at", "last_evaluated_at", "resolved_at"))
def n_stream_cases(spark, sf_dir):
    """The case fold as a Structured Streaming job (available-now), latest state per case."""
    from ledger_spark.streaming.case_stream import run_case_stream
    return run_case_stream(spark, sf_dir)


# ---------------------------------------------------------------- typed actions
def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_TYPED_SQL = _EVENTS_SQL.replace("WITH ev AS (", f"""WITH raw AS (
  SELECT *, CASE event_type WHEN 'signup' THEN {_list((*ac.ACTIVITY_TYPES, 'pigeon_sent'))}[CAST(event_id % 8 + 1 AS INTEGER)]
                            WHEN 'purchase' THEN {_list((*ac.RESOLUTION_TYPES, 'lost'))}[CAST(event_id % 9 + 1 AS INTEGER)] END AS action_type,
         CASE WHEN event_type NOT IN ('purchase', 'signup') OR event_id % 5 = 0 THEN NULL
              WHEN event_id % 5 = 1 THEN '  ' ELSE 'note ' || CAST(event_id AS VARCHAR) END AS note
  FROM events)
, ev AS (""").replace(
    "CASE WHEN event_type = 'purchase' THEN 'resolve'",
    f"""action_type, note, CASE WHEN event_type = 'purchase' AND action_type IN ({', '.join(repr(t) for t in ac.RESOLUTION_TYPES)})
                   AND (action_type <> 'other' OR length(trim(coalesce(note, ''))) > 0) THEN 'resolve'
              WHEN event_type = 'purchase' THEN 'refused'""").replace(
    "WHEN event_type = 'signup' THEN 'activity'", """WHEN event_type = 'signup' THEN 'activity'
              WHEN event_id % 11 = 0 OR event_id % 29 = 0 OR value IS NULL THEN 'ineligible'""").replace("  FROM events)\n, ev1", "  FROM raw)\n, ev1")

_ACTIONS_SQL = _TYPED_SQL + f"""
, actions AS (
  SELECT event_id, rx_number, CASE kind WHEN 'activity' THEN kind ELSE 'resolve' END AS kind, action_type, note,
         'staff-' || CAST(event_id % 7 AS VARCHAR) AS performed_by, ts AS performed_at, case_seq,
         CASE WHEN action_type IN ('pigeon_sent', 'lost') THEN 'invalid_type' WHEN NOT case_open_before THEN 'conflict'
              WHEN kind = 'refused' THEN 'note_required' WHEN kind = 'resolve' THEN 'resolved' ELSE 'accepted' END AS outcome
  FROM folded WHERE kind IN ('activity', 'resolve', 'refused'))
"""


def typed(spark, sf_dir) -> ac.TypedWorkflow:
    return ac.typed_workflow(derive.typed_workflow_events(spark, sf_dir))


@register("n_case_actions", _ACTIONS_SQL + """
SELECT * EXCLUDE (case_seq), CASE WHEN outcome IN ('accepted', 'resolved')
       THEN sha256('case|' || rx_number || '|' || CAST(case_seq AS VARCHAR)) END AS case_id FROM actions""", timestamps=("performed_at",))
def n_case_actions(spark, sf_dir):
    """Every activity and resolution with its case or the reason why it is refused."""
    return typed(spark, sf_dir).actions


@register("n_action_issues", _ACTIONS_SQL + "SELECT kind, outcome, count(*) AS actions FROM actions GROUP BY kind, outcome")
def n_action_issues(spark, sf_dir):
    """Actions by kind and outcome: unknown types, conflicts, missing notes."""
    return ac.action_issues(typed(spark, sf_dir).actions)


@register("n_typed_cases", _TYPED_SQL + "SELECT * FROM cases", ["latest_renewal_probability"],
          timestamps=("opened_at", "last_evaluated_at", "resolved_at"))
def n_typed_cases(spark, sf_dir):
    """Cases where refused resolutions leave a case open and refused predictions open none."""
    return typed(spark, sf_dir).cases


@register("n_prediction_issues", _TYPED_SQL + """
SELECT event_id, rx_number, CASE WHEN event_id % 29 = 0 OR renewal_probability IS NULL THEN 'missing_output' ELSE 'not_eligible' END AS code
FROM folded WHERE kind = 'ineligible'""")
def n_prediction_issues(spark, sf_dir):
    """Predictions that are not stored, with the reason."""
    return typed(spark, sf_dir).refused
