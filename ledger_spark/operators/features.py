"""Leakage-safe point-in-time observations and renewal labels (F1-F16).

For every fill the job derives supply dates, eligibility flags, the renewal
label and 15 history features known on the observation date.  The reference
walks each history in a Python loop and scans all prescriptions and all fills
of the medication per fill; here every step is a join, a grouping or a window:

* per-history running features (F8-F10) are one window per (patient,
  medication); very long histories are computed one *day block* at a time, with
  running day totals from a table of those blocks, so no task ever orders more
  than ``LONG_HISTORY_ROWS`` fills of other days.
* the renewal lookup (F5/F6) only needs "the first prescription date after
  the current prescription's date" for the same patient and NDC; that is one
  window over distinct (patient, ndc, day) rows, joined back.
* medication-wide history before the observation date (F11) is a running sum
  over a dense (medication, day) calendar, looked up with an equi-join on
  ``observation_date - 1``; raw fills are never windowed by medication, whose
  groups are huge.

Fills that lie in buckets of patients (``by_patient``) are read as they lie: only
the narrow look-ups, one row a prescription, are shuffled.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledger_spark.operators.scan import blocked_running

HISTORY_KEY = ("patient_id", "medication_id")
# Names and order of the observation columns.
IDENTIFIER_COLUMNS = (
    "observation_id", "observation_date", "expected_supply_end_date",
    "patient_id", "medication_id", "ndc", "prescription_id",
)
AUDIT_COLUMNS = ("current_refills_remaining",)
FEATURE_COLUMNS = (
    "current_quantity_billed", "current_days_supply", "current_refill_number",
    "previous_fill_count", "days_since_previous_fill",
    "average_previous_refill_interval_days", "std_previous_refill_interval_days",
    "latest_refill_timing_gap_days", "average_previous_timing_gap_days",
    "previous_early_fill_rate", "previous_on_time_fill_rate",
    "prescription_age_days", "medication_prior_fill_count",
    "medication_prior_average_days_supply", "medication_prior_average_quantity",
)
TARGET_COLUMN = "prescription_renewal_within_window"
LEGACY_TARGET_COLUMN = "refill_within_14_days"
OBSERVATION_COLUMNS = (*IDENTIFIER_COLUMNS, *AUDIT_COLUMNS, *FEATURE_COLUMNS, TARGET_COLUMN)
# Columns that must never be model inputs (identity, future, target construction).
FORBIDDEN_FEATURES = (
    "observation_id", "observation_date", "expected_supply_end_date", "patient_id",
    "medication_id", "ndc", "prescription_id", "current_refills_remaining",
    "target_window_end", "renewal_date", "next_fill_date", TARGET_COLUMN, LEGACY_TARGET_COLUMN,
)

EARLY_GAP = -1      # a gap below this is an early fill
ON_TIME_BAND = 1    # |gap| at most this is on time
LEGACY_WINDOW_DAYS = 14


@dataclass(frozen=True)
class SupplyEndConfig:
    """Business timing of supply-exhaustion observations."""

    outreach_lead_days: int = 10
    window_before_days: int = 0   # validated, not used (as in the reference)
    window_after_days: int = 7

    def __post_init__(self) -> None:
        if min(self.outreach_lead_days, self.window_before_days, self.window_after_days) < 0:
            raise ValueError("Supply-end timing values cannot be negative.")


def _day(c: str) -> Column:
    return F.unix_date(F.col(c))


def _flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def prepare_fills(fills: DataFrame) -> DataFrame:
    """Dates as calendar days; rows without a history key cannot be ordered (F1), ``fill_issues`` returns them."""
    return (fills.withColumn("fill_date", F.to_date("fill_date"))
            .filter(F.col("patient_id").isNotNull() & F.col("medication_id").isNotNull())
            .withColumn("fill_day", _day("fill_date")))


def fill_issues(fills: DataFrame, prescriptions: DataFrame) -> DataFrame:
    """One row per fill that cannot become a candidate, with the reason: no history key, or an unknown prescription."""
    known = prescriptions.select("prescription_id", F.lit(True).alias("_known")).distinct()
    issue = (F.when(F.col("patient_id").isNull(), "missing_patient")
             .when(F.col("medication_id").isNull(), "missing_medication")
             .when(F.col("_known").isNull(), "unknown_prescription"))
    return (fills.join(known, "prescription_id", "left").withColumn("issue", issue).filter("issue IS NOT NULL")
            .select("fill_id", "patient_id", "medication_id", "prescription_id", "fill_date", "issue"))


def with_next_fill_date(prepared: DataFrame) -> DataFrame:
    """``next_fill_date`` = lead(fill_date) in history order, walked in day blocks (F1)."""
    return blocked_running(prepared, list(HISTORY_KEY), "fill_day", ["fill_date", "fill_id"],
                           previous={"next_fill_date": "fill_date"}, reverse=True)


def prescription_ndc_from_fills(fills: DataFrame) -> DataFrame:
    """First NDC per prescription by (fill_date, fill_id), for prescriptions without one (F2)."""
    return fills.groupBy("prescription_id").agg(
        F.min_by("ndc", F.struct("fill_date", "fill_id")).alias("ndc"))


ID_PREFIX_CHARS = 3
HISTORY_BUCKETS = 1 << 16
LONG_HISTORY_ROWS = 200_000   # fills of one hash bucket of histories that one task orders


def long_histories(fills: DataFrame) -> DataFrame:
    """(``_hb``): the hash buckets of histories that hold a very long one; few rows, counted map-side, fit to broadcast."""
    counts = fills.groupBy(_history_bucket().alias("_hb")).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.filter(F.col("_rows") > LONG_HISTORY_ROWS).select("_hb")


def _history_bucket() -> Column:
    return F.pmod(F.xxhash64(*HISTORY_KEY), F.lit(HISTORY_BUCKETS))


def history_features(fills: DataFrame) -> DataFrame:
    """Per-fill history features F8-F10, one window per history; a very long one goes in (day, fill-id prefix) blocks.

    The fills are shuffled once, by history.  Only the rows of a hash bucket with
    more than ``LONG_HISTORY_ROWS`` fills are cut into blocks, so the block table
    is empty on usual data, and no task orders a whole history of any length.

    Within one calendar day every interval is 0 and every timing gap is minus
    the previous fill's days supply, so a block's contribution to the running
    counts depends only on its own rows plus the last fill of the previous
    block (interval = block day - previous block day, 0 on the same day).
    Running sums of intervals telescope to ``day - first_day``.  A block is
    one day of one history, further split by the first characters of the fill
    id (monotone in the (date, id) order).
    """
    ds, day = F.col("days_supply"), F.col("fill_day")
    columns = fills.columns
    fills = fills.withColumn("_p", F.substring("fill_id", 1, ID_PREFIX_CHARS)).withColumn("_hb", _history_bucket())
    long = F.broadcast(long_histories(fills).withColumn("_long", F.lit(True)))
    blk = [*HISTORY_KEY, "_bd", "_bp"]
    in_blk = Window.partitionBy(*blk).orderBy("fill_date", "fill_id")
    upto = in_blk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    big = _flag(-ds < EARLY_GAP)          # gap = -ds on a same-day refill
    small = _flag(F.abs(-ds) <= ON_TIME_BAND)
    rows = fills.join(long, "_hb", "left").select(
        *columns, "_p", F.when(F.col("_long"), day).alias("_bd"), F.when(F.col("_long"), F.col("_p")).alias("_bp"))
    rows = rows.select(
        "*",
        (F.row_number().over(in_blk) - 1).alias("_lpos"),
        F.lag("fill_day").over(in_blk).alias("_lprev_day"),
        F.lag(ds).over(in_blk).alias("_lprev_ds"),
        F.lag("_p").over(in_blk).alias("_lprev_p"),
    )
    # rows without a date go first and, by id prefix, count as one day
    undated = day.isNull() & F.col("_lprev_day").isNull() & (F.col("_p") == F.col("_lprev_p"))
    step = F.when(undated, 0).otherwise(day - F.col("_lprev_day"))
    gap = step - F.col("_lprev_ds")
    rows = rows.select(
        "*",
        F.sum(ds).over(upto).alias("_lds"),
        F.sum(_flag(gap < EARLY_GAP)).over(upto).alias("_learly"),
        F.sum(_flag(F.abs(gap) <= ON_TIME_BAND)).over(upto).alias("_lontime"),
        F.sum(F.coalesce(step.cast("long") * step.cast("long"), F.lit(0).cast("long"))).over(upto).alias("_lsq"),
        F.min("fill_day").over(upto).alias("_lfirst_day"),
    ).filter(day.isNotNull() & F.col("_p").isNotNull())

    blocks = fills.join(long, "_hb").withColumn("_bd", day).withColumn("_bp", F.col("_p")).groupBy(*blk).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(ds).alias("_ds"),
        F.sum(big).alias("_big"),
        F.sum(small).alias("_small"),
        F.max_by(ds, F.struct("fill_date", "fill_id")).alias("_last_ds"),
    )
    hist = Window.partitionBy(*HISTORY_KEY).orderBy("_bd", "_bp")
    before = hist.rowsBetween(Window.unboundedPreceding, -1)
    upto_blk = hist.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.select(
        "*",
        F.lag("_bd").over(hist).alias("_prev_day"),
        F.lag("_last_ds").over(hist).alias("_prev_last_ds"),
        F.min("_bd").over(Window.partitionBy(*HISTORY_KEY)).alias("_first_day"),
    )
    gap1 = F.col("_bd") - F.col("_prev_day") - F.col("_prev_last_ds")
    e1 = F.when(gap1 < EARLY_GAP, 1).otherwise(0)
    t1 = F.when(F.abs(gap1) <= ON_TIME_BAND, 1).otherwise(0)
    last_big = _flag(-F.col("_last_ds") < EARLY_GAP)
    last_small = _flag(F.abs(-F.col("_last_ds")) <= ON_TIME_BAND)
    blocks = blocks.select(
        "*", e1.alias("_e1"), t1.alias("_t1"),
        (e1 + F.col("_big") - last_big).alias("_blk_early"),
        (t1 + F.col("_small") - last_small).alias("_blk_ontime"),
        F.coalesce(F.pow(F.col("_bd") - F.col("_prev_day"), 2), F.lit(0)).cast("long").alias("_sq"),
    )
    blocks = blocks.select(
        *blk, "_prev_day", "_prev_last_ds", "_first_day", "_e1", "_t1",
        F.sum("_n").over(before).alias("_n_before"),
        F.sum("_ds").over(before).alias("_ds_before"),
        F.sum("_blk_early").over(before).alias("_early_before"),
        F.sum("_blk_ontime").over(before).alias("_ontime_before"),
        F.sum("_sq").over(upto_blk).alias("_sq_upto"),
    )

    def off(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    j = rows.join(blocks, blk, "left")                          # an unblocked row has no offsets
    k = off("_n_before") + F.col("_lpos")                       # gaps / intervals so far
    first_in_blk = F.col("_lpos") == 0
    prev_day = F.when(first_in_blk, F.col("_prev_day")).otherwise(F.col("_lprev_day"))
    prev_ds = F.when(first_in_blk, F.col("_prev_last_ds")).otherwise(F.col("_lprev_ds"))
    since_prev = day - prev_day
    s1 = (day - F.coalesce("_first_day", "_lfirst_day")).cast("long")   # sum of intervals
    s2 = (off("_sq_upto") + F.col("_lsq")).cast("long")                  # sum of squared intervals
    ds_before_row = off("_ds_before") + F.col("_lds") - ds
    early = off("_early_before") + off("_e1") + F.col("_learly")
    ontime = off("_ontime_before") + off("_t1") + F.col("_lontime")
    has = k >= 1
    kd = k.cast("double")
    var_num = (k.cast("long") * s2 - s1 * s1).cast("double")
    return j.select(
        *columns,
        k.cast("int").alias("previous_fill_count"),
        since_prev.cast("double").alias("days_since_previous_fill"),
        F.when(has, s1 / kd).alias("average_previous_refill_interval_days"),
        F.when(k >= 2, F.sqrt(F.greatest(var_num, F.lit(0.0))) / kd)
        .alias("std_previous_refill_interval_days"),
        (since_prev - prev_ds).cast("double").alias("latest_refill_timing_gap_days"),
        F.when(has, (s1 - ds_before_row) / kd).alias("average_previous_timing_gap_days"),
        F.when(has, early / kd).alias("previous_early_fill_rate"),
        F.when(has, ontime / kd).alias("previous_on_time_fill_rate"),
    )


def next_prescription_day(fills: DataFrame, prescriptions: DataFrame) -> DataFrame:
    """First prescription day after each fill's prescription day, same patient and NDC.

    Returns (patient_id, ndc, cur_rx_day, next_rx_day).  Both "renewal already
    received" (F5) and the first future renewal (F6) follow from it: a
    prescription in (cur, obs] exists iff next <= obs, and when none does the
    first one after obs is next itself.  The window runs over distinct days of
    one (patient, ndc), never over all fills.
    """
    rx = prescriptions.select("patient_id", F.col("ndc").cast("string").alias("ndc"),
                              _day("prescription_date").alias("day"), F.lit(1).alias("is_rx"))
    ask = fills.select("patient_id", F.col("ndc").cast("string").alias("ndc"),
                       F.col("cur_rx_day").alias("day"), F.lit(0).alias("is_rx"))
    days = rx.unionByName(ask).groupBy("patient_id", "ndc", "day").agg(F.max("is_rx").alias("is_rx"))
    after = (Window.partitionBy("patient_id", "ndc").orderBy("day")
             .rangeBetween(1, Window.unboundedFollowing))
    return days.select(
        "patient_id", "ndc", F.col("day").alias("cur_rx_day"),
        F.min(F.when(F.col("is_rx") == 1, F.col("day"))).over(after).alias("next_rx_day"),
    )


def prescription_days(prescriptions: DataFrame) -> DataFrame:
    """(patient_id, ndc, rx_days): the distinct prescription days of each patient and NDC, at most one a calendar day."""
    return prescriptions.select("patient_id", F.col("ndc").cast("string").alias("ndc"), _day("prescription_date").alias("day")) \
        .groupBy("patient_id", "ndc").agg(F.collect_set("day").alias("rx_days"))


def medication_history_calendar(fills: DataFrame) -> DataFrame:
    """Running fill count, days-supply and quantity totals per (medication, day).

    Daily totals are pre-aggregated map-side; the dense calendar per medication
    runs from its first fill to its last supply end, so every observation day
    has a row.  Size is medications x calendar days, independent of fill volume.
    """
    daily = fills.groupBy("medication_id", "fill_day").agg(
        F.count(F.lit(1)).alias("_c"),
        F.sum("days_supply").alias("_s"),
        F.sum("quantity_billed").alias("_q"),
    )
    span = fills.groupBy("medication_id").agg(
        F.min("fill_day").alias("_lo"), F.max(F.col("fill_day") + F.col("days_supply")).alias("_hi"))
    calendar = span.select("medication_id", F.explode(F.sequence("_lo", "_hi")).alias("fill_day"))
    upto = Window.partitionBy("medication_id").orderBy("fill_day").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    dense = calendar.join(daily, ["medication_id", "fill_day"], "left")
    return dense.select(
        "medication_id", F.col("fill_day").alias("calendar_day"),
        F.sum(F.coalesce("_c", F.lit(0))).over(upto).alias("cum_fills"),
        F.sum(F.coalesce("_s", F.lit(0))).over(upto).alias("cum_days_supply"),
        F.sum(F.coalesce("_q", F.lit(0.0))).over(upto).alias("cum_quantity"),
    )


def candidate_features(fills: DataFrame, prescriptions: DataFrame, lead_days: int = 10, by_patient: int | None = None,
                       checkpoint: Callable[[str, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Every fill with supply dates, history and medication features and the next renewal day.

    Independent of the label window: ``with_label`` adds the window-specific
    columns, so several windows share one feature computation.  Eligibility is
    applied *after* the windows: ineligible fills are history too.

    ``by_patient``: the fills lie in so many parts by patient, none with very many fills.
    The look-ups are then brought to the fills' parts and the wide rows are never
    shuffled.  ``checkpoint(name, df)`` writes the small medication calendar first.
    Results are the same with and without.
    """
    f = prepare_fills(fills)
    rx = prescriptions.withColumn("prescription_date", F.to_date("prescription_date"))
    if "ndc" not in rx.columns:
        rx = rx.join(prescription_ndc_from_fills(f), "prescription_id", "left")

    rx_dates = rx.groupBy("prescription_id").agg(F.min(_day("prescription_date")).alias("cur_rx_day"), F.count(F.lit(1)).alias("_rx_rows"))
    # look-ups go by the distinct (prescription, patient, NDC) of the fills, so the
    # wide feature rows are shuffled once for all of them
    info = f.select("prescription_id", "patient_id", "ndc").distinct().join(rx_dates, "prescription_id", "left")
    if by_patient:
        days = prescription_days(rx).select(F.col("patient_id").alias("_dpat"), F.col("ndc").alias("_dndc"), "rx_days")
        info = info.repartition(by_patient, "patient_id")
        info = info.join(days, (F.col("patient_id") == F.col("_dpat")) & (F.col("ndc").cast("string") == F.col("_dndc")), "left") \
            .withColumn("next_rx_day", F.array_min(F.filter("rx_days", lambda d: d > F.col("cur_rx_day"))))
    else:
        nxt = next_prescription_day(info.filter("_rx_rows IS NOT NULL"), rx)
        info = info.join(nxt, ["patient_id", "ndc", "cur_rx_day"], "left")
    info = info.select(
        F.col("prescription_id").alias("_ip"), F.col("patient_id").alias("_ipat"), F.col("ndc").alias("_indc"),
        "cur_rx_day", "_rx_rows", "next_rx_day")
    feats = history_features(f)
    # an unknown or repeated prescription raises, as in the reference
    unknown = F.raise_error(F.concat(F.lit("Unknown prescription of fill "), F.coalesce("fill_id", F.lit("NULL")),
                                     F.lit("; fill_issues lists all such fills.")))
    repeated = F.raise_error(F.concat(F.lit("More than one row of prescription "), F.col("prescription_id"),
                                      F.lit("; integrity.reference_issues lists them.")))
    feats = feats.join(info, (F.col("prescription_id") == F.col("_ip")) & (F.col("patient_id") == F.col("_ipat"))
                       & F.col("ndc").eqNullSafe(F.col("_indc")), "left").withColumn(
        "cur_rx_day", F.when(F.col("_rx_rows").isNull(), unknown.cast("int")).when(F.col("_rx_rows") > 1, repeated.cast("int"))
        .otherwise(F.col("cur_rx_day"))).drop("_ip", "_ipat", "_indc", "_rx_rows")

    end_day = F.col("fill_day") + F.col("days_supply")
    obs_day = end_day - lead_days
    feats = feats.select("*", end_day.alias("_end_day"), obs_day.alias("_obs_day"))
    cal = medication_history_calendar(f)
    if checkpoint:
        cal = checkpoint("medication-calendar", cal)
    cal = cal.withColumnRenamed("medication_id", "_cal_med")       # a fill before its medication's calendar keeps its own
    feats = feats.join(cal, (F.col("medication_id") == F.col("_cal_med")) & (F.col("calendar_day") == F.col("_obs_day") - 1), "left")
    self_before = F.col("fill_day") < F.col("_obs_day")       # own fill is in the window
    med_n = F.coalesce("cum_fills", F.lit(0)) - _flag(self_before)
    med_s = F.coalesce("cum_days_supply", F.lit(0)) - F.when(self_before, F.col("days_supply")).otherwise(0)
    med_q = F.coalesce("cum_quantity", F.lit(0.0)) - F.when(self_before, F.col("quantity_billed")).otherwise(0.0)
    already = F.coalesce(F.col("next_rx_day") <= F.col("_obs_day"), F.lit(False))
    return feats.select(
        F.col("fill_id").alias("observation_id"),
        F.date_from_unix_date("_obs_day").alias("observation_date"),
        F.date_from_unix_date("_end_day").alias("expected_supply_end_date"),
        "patient_id", "medication_id", "ndc", "prescription_id", "fill_date",
        F.col("refills_remaining").cast("int").alias("current_refills_remaining"),
        F.col("quantity_billed").cast("double").alias("current_quantity_billed"),
        F.col("days_supply").cast("double").alias("current_days_supply"),
        F.col("refill_number").cast("double").alias("current_refill_number"),
        F.col("previous_fill_count").cast("double").alias("previous_fill_count"),
        "days_since_previous_fill", "average_previous_refill_interval_days",
        "std_previous_refill_interval_days", "latest_refill_timing_gap_days",
        "average_previous_timing_gap_days", "previous_early_fill_rate",
        "previous_on_time_fill_rate",
        (F.col("_obs_day") - F.col("cur_rx_day")).cast("double").alias("prescription_age_days"),
        med_n.cast("double").alias("medication_prior_fill_count"),
        F.when(med_n > 0, med_s / med_n).alias("medication_prior_average_days_supply"),
        F.when(med_n > 0, med_q / med_n).alias("medication_prior_average_quantity"),
        F.date_from_unix_date("next_rx_day").alias("renewal_date"),
        (F.col("refills_remaining") == 0).alias("zero_refill"),
        (F.col("_obs_day") < F.col("fill_day")).alias("lead_time_ineligible"),
        already.alias("renewal_already_received"),
    )


def with_label(features: DataFrame, study_end: object, window_after_days: int = 7) -> DataFrame:
    """Target window, renewal label and censoring for one window length."""
    study_end_d = dt.date.fromisoformat(str(study_end)[:10])
    window_end = F.date_add("expected_supply_end_date", window_after_days)
    target = F.coalesce(F.col("renewal_date") <= window_end, F.lit(False))
    cols = [c for c in features.columns if c not in ("zero_refill", "lead_time_ineligible",
                                                     "renewal_already_received", "renewal_date")]
    return features.select(
        *cols, target.cast("int").alias(TARGET_COLUMN), window_end.alias("target_window_end"),
        "renewal_date", "zero_refill", "lead_time_ineligible",
        (window_end > F.lit(study_end_d)).alias("censored"), "renewal_already_received",
    )


def supply_end_candidates(fills: DataFrame, prescriptions: DataFrame, study_end: object,
                          config: SupplyEndConfig | None = None) -> DataFrame:
    """Every fill with supply dates, eligibility flags, label and features."""
    cfg = config or SupplyEndConfig()
    return with_label(candidate_features(fills, prescriptions, cfg.outreach_lead_days),
                      study_end, cfg.window_after_days)


def eligible() -> Column:
    return (F.col("zero_refill") & ~F.col("lead_time_ineligible") & ~F.col("censored")
            & ~F.col("renewal_already_received"))


def observations(candidates: DataFrame, sort: bool = False) -> DataFrame:
    """Eligible fills as observations: 7 ids, 1 audit column, 15 features, target."""
    out = candidates.filter(eligible()).select(*OBSERVATION_COLUMNS)
    return out.orderBy("observation_date", "observation_id") if sort else out


def eligibility_accounting(candidates: DataFrame) -> DataFrame:
    """Waterfall: each count excludes the rows of the earlier steps."""
    z, c = F.col("zero_refill"), F.col("censored")
    lead, already = F.col("lead_time_ineligible"), F.col("renewal_already_received")
    return candidates.agg(
        F.count(F.lit(1)).alias("candidate_fill_count"),
        F.count_if(z).alias("zero_refill_candidate_count"),
        F.count_if(z & c).alias("censored_count"),
        F.count_if(z & ~c & lead).alias("lead_time_ineligible_count"),
        F.count_if(z & ~c & ~lead & already).alias("renewal_already_received_count"),
        F.count_if(eligible()).alias("observation_count"),
        F.sum(F.when(eligible(), F.col(TARGET_COLUMN))).alias("positive_count"),
    )


def legacy_refill_observations(fills: DataFrame, study_end: object) -> DataFrame:
    """Superseded target: refill 1..14 days after the fill date."""
    study_end_d = dt.date.fromisoformat(str(study_end)[:10])
    nxt = with_next_fill_date(prepare_fills(fills))
    last_day = study_end_d - dt.timedelta(days=LEGACY_WINDOW_DAYS)
    days_to_next = F.datediff("next_fill_date", "fill_date")
    return nxt.filter(F.col("fill_date") <= F.lit(last_day)).select(
        F.col("fill_id").alias("observation_id"),
        F.col("fill_date").alias("observation_date"),
        F.coalesce(days_to_next.between(1, LEGACY_WINDOW_DAYS), F.lit(False)).cast("int")
        .alias(LEGACY_TARGET_COLUMN),
    )


def leakage_violations(feature_columns: list[str]) -> list[str]:
    """Feature names that carry identity, future or target information (F16)."""
    return [c for c in feature_columns if c in FORBIDDEN_FEATURES]
