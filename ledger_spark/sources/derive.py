"""Domain tables derived from the test data set.

The domain is billing / ordering exports and prescription fill histories.  The
test data is a TPC-H-like star schema, so these builders map it onto the
domain (the mapping is fixed in FIXTURES.md §4):

* billing   = ``lineitem`` rows with ``l_linestatus = 'F'``
* ordering  = ``lineitem`` rows with ``l_linestatus = 'O'``
* fills     = all ``lineitem`` rows, one history per (customer, part type)
* prescriptions = groups of three consecutive fills of a history
* workflow events = ``events`` rows as predictions, activities, resolutions

Dimension lookups are LEFT joins on unique keys, so a builder joins a
dimension only when a requested column needs it: the row set never changes,
and the scan and shuffle stay as narrow as the caller's projection.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledger_spark.operators.scan import blocked_running
from ledger_spark.sources.testdata import table

BILLING_COLUMNS = (
    "billing_id", "patient_id", "patient_name", "date_of_birth", "prescription_id", "ndc",
    "drug_name", "billing_date", "insurance_name", "bin_number", "quantity_billed",
    "days_supply", "refills_remaining",
)
ORDERING_COLUMNS = ("order_id", "ndc", "drug_name", "ordered_date", "quantity_ordered")
FILL_COLUMNS = (
    "fill_id", "billing_id", "fill_date", "patient_id", "prescription_id", "medication_id",
    "ndc", "drug_name", "quantity_billed", "days_supply", "refill_number",
    "refills_remaining", "insurance_name", "bin_number",
)
PRESCRIPTION_COLUMNS = (
    "prescription_id", "patient_id", "medication_id", "ndc", "prescription_date",
    "refills_authorized",
)

# Fixed values of the mapping: days supply chosen by l_linenumber (1-based).
DAYS_SUPPLY_BY_LINE = (7, 14, 30, 60, 90, 180, 365)
REFILLS_AUTHORIZED = 2
FILLS_PER_PRESCRIPTION = REFILLS_AUTHORIZED + 1

_NEEDS_ORDERS = {"patient_id", "patient_name"}
_NEEDS_CUSTOMER = {"patient_name"}
_NEEDS_PART_NAME = {"drug_name"}
_NEEDS_SUPPLIER = {"insurance_name", "bin_number"}


def _record_key() -> Column:
    """Unique line key: order, line, part, supplier and ship day."""
    return F.concat_ws(
        "-",
        F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
        F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
        F.date_format(F.to_date("l_shipdate"), "yyyyMMdd"),
    )


def _lineitem_with(spark: SparkSession, sf_dir: str, wanted: set[str],
                   status: str | None, part_column: str) -> DataFrame:
    """lineitem (optionally one line status) with only the dimensions ``wanted`` needs."""
    li = table(spark, sf_dir, "lineitem")
    if status is not None:
        li = li.filter(F.col("l_linestatus") == status)
    li = li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                   "l_shipdate")
    if wanted & _NEEDS_ORDERS:
        orders = table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        if wanted & _NEEDS_CUSTOMER:      # names go to the orders first: the lines are not shuffled by customer
            customer = table(spark, sf_dir, "customer").select(
                F.col("c_custkey").alias("o_custkey"), "c_name")
            orders = orders.join(customer, "o_custkey", "left")
        li = li.join(orders, "l_orderkey", "left")
    if wanted & _NEEDS_PART_NAME:
        part = table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("l_partkey"), F.col(part_column).alias("_part_value"))
        li = li.join(part, "l_partkey", "left")
    if wanted & _NEEDS_SUPPLIER:
        supplier = table(spark, sf_dir, "supplier").select(
            F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey", "s_acctbal")
        li = li.join(supplier, "l_suppkey", "left")
    return li


def _insurer(li: DataFrame) -> tuple[Column, Column]:
    covered = ~(F.col("s_acctbal") < 0)
    return (
        F.when(covered, F.col("s_name")).alias("insurance_name"),
        F.when(covered, F.lpad(F.col("s_nationkey").cast("string"), 6, "0")).alias("bin_number"),
    )


def _select(columns: Iterable[str] | None, allowed: tuple[str, ...]) -> list[str]:
    chosen = list(allowed if columns is None else columns)
    unknown = [c for c in chosen if c not in allowed]
    if unknown:
        raise ValueError(f"unknown columns {unknown}")
    return chosen


def billing(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Canonical billing export (13 typed columns) from finished line items."""
    cols = _select(columns, BILLING_COLUMNS)
    li = _lineitem_with(spark, sf_dir, set(cols), "F", "p_name")
    exprs: dict[str, Column] = {
        "billing_id": _record_key(),
        "patient_id": F.concat(F.lit("PT-"), F.col("o_custkey").cast("string")) if "patient_id" in cols else None,
        "patient_name": F.col("c_name") if "patient_name" in cols else None,
        "date_of_birth": F.lit(None).cast("date"),
        "prescription_id": F.concat(F.lit("RX-"), F.col("l_orderkey").cast("string")),
        "ndc": F.lpad(F.col("l_partkey").cast("string"), 11, "0"),
        "drug_name": F.col("_part_value") if "drug_name" in cols else None,
        "billing_date": F.to_date("l_shipdate"),
        "quantity_billed": F.col("l_quantity").cast("double"),
        "days_supply": (F.col("l_linenumber") * 10).cast("int"),
        "refills_remaining": F.lit(None).cast("int"),
    }
    if set(cols) & _NEEDS_SUPPLIER:
        exprs["insurance_name"], exprs["bin_number"] = _insurer(li)
    return li.select(*[exprs[c].alias(c) for c in cols])


def medication_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product master: one drug name per NDC (the part table)."""
    return table(spark, sf_dir, "part").select(
        F.lpad(F.col("p_partkey").cast("string"), 11, "0").alias("ndc"), F.col("p_name").alias("drug_name"))


def ordering(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Canonical ordering export (5 typed columns) from open line items."""
    cols = _select(columns, ORDERING_COLUMNS)
    li = _lineitem_with(spark, sf_dir, set(cols), "O", "p_name")
    exprs: dict[str, Column] = {
        "order_id": _record_key(),
        "ndc": F.lpad(F.col("l_partkey").cast("string"), 11, "0"),
        "drug_name": F.col("_part_value") if "drug_name" in cols else None,
        "ordered_date": F.to_date("l_shipdate"),
        "quantity_ordered": F.col("l_quantity").cast("double"),
    }
    return li.select(*[exprs[c].alias(c) for c in cols])


def fill_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a fill of (customer, part type), also those without a patient or medication."""
    wanted = {"patient_id", "drug_name", "insurance_name"}
    li = _lineitem_with(spark, sf_dir, wanted, None, "p_type")
    insurance_name, bin_number = _insurer(li)
    days = F.array(*[F.lit(d) for d in DAYS_SUPPLY_BY_LINE])
    return li.select(
        _record_key().alias("fill_id"),
        F.to_date("l_shipdate").alias("fill_date"),
        _patient_id().alias("patient_id"),
        F.col("_part_value").alias("medication_id"),
        F.concat(F.lit("NDC-"), F.col("_part_value")).alias("ndc"),
        F.col("l_quantity").cast("double").alias("quantity_billed"),
        F.element_at(days, F.col("l_linenumber")).cast("int").alias("days_supply"),
        insurance_name, bin_number,
    )


def keyless_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fills without a patient or medication: in no history, reported by ``features.fill_issues``."""
    return fill_rows(spark, sf_dir).filter(F.col("patient_id").isNull() | F.col("medication_id").isNull())


PATIENT_BUCKETS = 4096
LONG_HISTORY_ROWS = 1_000_000   # lines of one hash bucket of patients whose histories are ranked by plain windows


def _patient_id() -> Column:
    return F.concat(F.lit("PT-"), F.col("o_custkey").cast("string"))


def _patient_bucket(patient_id: Column) -> Column:
    return F.pmod(F.xxhash64(patient_id), F.lit(PATIENT_BUCKETS))


def _long_patients(spark: SparkSession, sf_dir: str) -> list[int]:
    """The hash buckets of patients with very many lines: at most ``PATIENT_BUCKETS`` numbers.

    Lines are counted by order before they meet the orders: one narrow row an order is shuffled.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("_lines"))
    orders = table(spark, sf_dir, "orders").filter(F.col("o_custkey").isNotNull()).select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    counts = lines.join(orders, "l_orderkey").groupBy(_patient_bucket(_patient_id()).alias("b")).agg(F.sum("_lines").alias("n"))
    return [r["b"] for r in counts.filter(F.col("n") > LONG_HISTORY_ROWS).collect()]


FILLS_PER_BUCKET, LEAST_BUCKETS = 200_000, 8


def fill_buckets(spark: SparkSession, sf_dir: str) -> int | None:
    """Into how many parts the fills are dealt by patient; None if a patient has too many for one part."""
    if _long_patients(spark, sf_dir):
        return None
    return max(LEAST_BUCKETS, -(-table(spark, sf_dir, "lineitem").count() // FILLS_PER_BUCKET))


def fills(spark: SparkSession, sf_dir: str, buckets: int | None = None) -> DataFrame:
    """Fill history: every line item with a patient and a medication.

    The rank ``n`` of a fill in its history (by fill date, then fill id) sets
    the prescription (``n div 3``) and refill counters.  Patients are counted
    first, by hash bucket and on the narrow order lines.  Where a bucket holds
    more than ``LONG_HISTORY_ROWS`` lines, the rank is a blocked running count
    (see ``operators.scan``) over (day, fill-id prefix) blocks, so a very long
    history -- or a very busy day of one -- is never ranked in a single task.
    All other fills are ranked by one window, without a table of blocks.  With
    ``buckets`` (from ``fill_buckets``) the rows are dealt by patient into so many
    partitions, and no patient has very many lines.
    """
    base = fill_rows(spark, sf_dir).filter(F.col("patient_id").isNotNull() & F.col("medication_id").isNotNull())
    long = [] if buckets else _long_patients(spark, sf_dir)
    if buckets:
        base = base.repartition(buckets, "patient_id")
    in_long = _patient_bucket(F.col("patient_id")).isin(long) if long else F.lit(False)
    history = Window.partitionBy("patient_id", "medication_id").orderBy("fill_date", "fill_id")
    ranked = (base.filter(~in_long) if long else base).withColumn("_n", (F.row_number().over(history) - 1).cast("long"))
    if long:
        # blocks: (day, first characters of the fill id) -- monotone in (fill_date, fill_id)
        busy = base.filter(in_long).withColumn("_blk", F.struct(F.unix_date("fill_date").alias("d"),
                                                                F.substring("fill_id", 1, 3).alias("p")))
        ranked = ranked.unionByName(blocked_running(busy, ["patient_id", "medication_id"], "_blk",
                                                    ["fill_date", "fill_id"], position="_n").drop("_blk"))
    n = F.col("_n")
    return ranked.select(
        "fill_id",
        F.col("fill_id").alias("billing_id"),
        "fill_date",
        "patient_id",
        F.concat_ws("/", "patient_id", "medication_id",
                    F.floor(n / FILLS_PER_PRESCRIPTION).cast("string")).alias("prescription_id"),
        "medication_id",
        "ndc",
        F.col("medication_id").alias("drug_name"),
        "quantity_billed",
        "days_supply",
        (n % FILLS_PER_PRESCRIPTION).cast("int").alias("refill_number"),
        (F.lit(REFILLS_AUTHORIZED) - n % FILLS_PER_PRESCRIPTION).cast("int").alias("refills_remaining"),
        "insurance_name",
        "bin_number",
    )


def prescriptions(fill_df: DataFrame) -> DataFrame:
    """One row per prescription: its first fill date and its history keys."""
    return fill_df.groupBy("prescription_id", "patient_id", "medication_id", "ndc").agg(
        F.min("fill_date").alias("prescription_date"),
    ).select(*PRESCRIPTION_COLUMNS[:-1], F.lit(REFILLS_AUTHORIZED).alias("refills_authorized"))


# Fixed values of the workflow mapping.
PROBABILITY_OFFSET = 50.0
DAYS_LEFT_BASE = 10
DAYS_LEFT_CYCLE = 18


def workflow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follow-up workflow events from ``events`` (see ``workflow_events_from``).

    ``purchase`` resolves the open case of the prescription, ``signup`` logs an
    activity, every other type is a model prediction with probability
    ``value / (value + 50)`` and ``10 - event_id mod 18`` days of supply left.
    """
    return workflow_events_from(table(spark, sf_dir, "events"))


def workflow_events_from(events: DataFrame) -> DataFrame:
    """The event mapping as a projection, usable on a batch or a streaming frame."""
    ev = events.select("event_id", "ts", "user_id", "event_type", "value")
    kind = (F.when(F.col("event_type") == "purchase", "resolve")
            .when(F.col("event_type") == "signup", "activity")
            .otherwise("predict"))
    is_pred = kind == "predict"
    return ev.select(
        "event_id",
        "ts",
        F.concat(F.lit("RX-"), F.col("user_id").cast("string")).alias("rx_number"),
        kind.alias("kind"),
        F.when(is_pred, F.col("value") / (F.col("value") + F.lit(PROBABILITY_OFFSET)))
        .alias("renewal_probability"),
        F.when(is_pred, F.lit(DAYS_LEFT_BASE) - F.pmod(F.col("event_id"), F.lit(DAYS_LEFT_CYCLE)))
        .cast("int").alias("days_until_supply_end"),
    )


def typed_workflow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workflow events with the type, note and performer of their actions, by rules on the event id.

    One type in eight (activities) or nine (resolutions) is not a known one; notes are absent, blank or
    given in turn; one prediction in eleven has 40 days of supply left, one in 29 no probability.
    """
    from ledger_spark.operators.actions import ACTIVITY_TYPES, RESOLUTION_TYPES
    ev, n = workflow_events(spark, sf_dir), F.col("event_id")
    activity = F.element_at(F.array(*[F.lit(t) for t in (*ACTIVITY_TYPES, "pigeon_sent")]), (F.pmod(n, F.lit(8)) + 1).cast("int"))
    resolution = F.element_at(F.array(*[F.lit(t) for t in (*RESOLUTION_TYPES, "lost")]), (F.pmod(n, F.lit(9)) + 1).cast("int"))
    predicted, acted = F.col("kind") == "predict", F.col("kind") != "predict"
    return ev.select(
        "event_id", "ts", "rx_number", "kind",
        F.when(F.pmod(n, F.lit(29)) != 0, F.col("renewal_probability")).alias("renewal_probability"),
        F.when(predicted & (F.pmod(n, F.lit(11)) == 0), F.lit(40)).otherwise(F.col("days_until_supply_end")).alias("days_until_supply_end"),
        F.when(F.col("kind") == "activity", activity).when(F.col("kind") == "resolve", resolution).alias("action_type"),
        F.when(acted & (F.pmod(n, F.lit(5)) == 1), "  ").when(acted & (F.pmod(n, F.lit(5)) > 1), F.concat(F.lit("note "), n.cast("string"))).alias("note"),
        F.when(acted, F.concat(F.lit("staff-"), F.pmod(n, F.lit(7)).cast("string"))).alias("performed_by"))


# Fixed values of the export rendering: date styles and the key moduli that
# plant each kind of defect.  Every row is kept; only its text changes.
EXPORT_DATE_STYLES = ("yyyy-MM-dd", "M/d/yyyy", "yyyyMMdd", "d MMM yyyy", "yyyy/MM/dd", "MMM d, yyyy")
BLANK_ID_EVERY = 101       # billing_id blank
NULL_PATIENT_EVERY = 103   # patient_id missing
BAD_DATE_EVERY = 97        # billing_date unparseable (by part key)
BAD_NUMBER_EVERY = 53      # quantity not a number (by supplier key)
NEGATIVE_EVERY = 89        # negative quantity (by part key)
FRACTION_EVERY = 107       # fractional days supply


def billing_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Billing as a raw string export: mixed date styles, padding and planted defects.

    Used to exercise validation (C) at scale; ``row_id`` is the line key.
    """
    li = _lineitem_with(spark, sf_dir, {"patient_id", "patient_name", "drug_name", "insurance_name"},
                        "F", "p_name")
    insurance_name, bin_number = _insurer(li)
    key = _record_key()
    ok, pk, sk, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    ship = F.to_date("l_shipdate")
    style = F.pmod(ok, F.lit(len(EXPORT_DATE_STYLES)))
    date_text = None
    for i, fmt in enumerate(EXPORT_DATE_STYLES):
        date_text = (F.when(style == i, F.date_format(ship, fmt)) if date_text is None
                     else date_text.when(style == i, F.date_format(ship, fmt)))
    qty = F.regexp_replace(F.col("l_quantity").cast("decimal(18,2)").cast("string"), r"[.]?0+$", "")
    return li.select(
        key.alias("row_id"),
        F.when(F.pmod(ok, F.lit(BLANK_ID_EVERY)) == 0, F.lit("  ")).otherwise(key).alias("billing_id"),
        F.when(F.pmod(ok, F.lit(NULL_PATIENT_EVERY)) == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("PT-"), F.col("o_custkey").cast("string"))).alias("patient_id"),
        F.when(ln == 3, F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))).otherwise(F.col("c_name"))
        .alias("patient_name"),
        F.lit(None).cast("string").alias("date_of_birth"),
        F.concat(F.lit("RX-"), ok.cast("string")).alias("prescription_id"),
        F.when(ln == 2, F.concat(F.lit(" "), F.lpad(pk.cast("string"), 11, "0"), F.lit(" ")))
        .otherwise(F.lpad(pk.cast("string"), 11, "0")).alias("ndc"),
        F.col("_part_value").alias("drug_name"),
        F.when(F.pmod(pk, F.lit(BAD_DATE_EVERY)) == 0, F.lit("not-a-date")).otherwise(date_text)
        .alias("billing_date"),
        insurance_name, bin_number,
        F.when(F.pmod(sk, F.lit(BAD_NUMBER_EVERY)) == 0, F.lit("n.a."))
        .when(F.pmod(pk, F.lit(NEGATIVE_EVERY)) == 0, F.concat(F.lit("-"), qty))
        .otherwise(qty).alias("quantity_billed"),
        F.when(F.pmod(ok, F.lit(FRACTION_EVERY)) == 2, F.concat((ln * 10).cast("string"), F.lit(".5")))
        .otherwise((ln * 10).cast("string")).alias("days_supply"),
        F.lit(None).cast("string").alias("refills_remaining"),
    )


def _title(name: str) -> str:
    return " ".join(w.capitalize() for w in name.split("_"))


# Header styles of supplier billing exports, built by rule from the canonical
# names: canonical, title case, first aliases plus an unmapped column, upper
# case with dashes, two quantity aliases (ambiguous), no quantity column
# (required field missing), and a duplicated patient id header.
def export_header_styles() -> list[list[str]]:
    from ledger_spark.operators.headers import BILLING_ALIASES
    names = [f for f in BILLING_ALIASES]
    first_alias = [BILLING_ALIASES[f][0] for f in names]
    return [
        names,
        [_title(n) for n in names],
        first_alias + ["Store Number"],
        [n.upper().replace("_", "-") for n in names],
        [a for a in first_alias if a != "qty_billed"] + ["Qty Dispensed", "Billed Qty"],
        [n for n in names if n != "quantity_billed"],
        names + ["Patient ID"],
    ]


COPIED_EVERY = 109         # a line that stands twice in its file (by order key)


def export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_file, kind, key, copy, value): one CSV file per supplier as text, a header (kind 0) and its billing rows.

    Headers follow ``export_header_styles``; every value is quoted, names of the fourth line of an order hold a
    line break and quotes, and some lines stand twice.
    """
    from ledger_spark.operators.headers import BILLING_ALIASES, normalize_header
    field_of = {normalize_header(a): f for f, aliases in BILLING_ALIASES.items() for a in (f, *aliases)}
    styles = export_header_styles()

    def line(cells: list[Column]) -> Column:
        return F.concat_ws(",", *[F.coalesce(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')), F.lit("")) for c in cells])

    def styled(key: Column, texts: list[Column]) -> Column:
        style, out = F.pmod(key, F.lit(len(styles))), None
        for i, text in enumerate(texts):
            out = F.when(style == i, text) if out is None else out.when(style == i, text)
        return out

    heads = table(spark, sf_dir, "supplier").select(
        export_file(F.col("s_suppkey")).alias("source_file"), F.lit(0).alias("kind"), F.lit("").alias("key"), F.lit(0).alias("copy"),
        styled(F.col("s_suppkey"), [line([F.lit(h) for h in hs]) for hs in styles]).alias("value"))
    parts = F.split("row_id", "-")
    rows = billing_export(spark, sf_dir).withColumn("patient_name", F.when(
        parts[1] == "4", F.concat("patient_name", F.lit('\n"q"'))).otherwise(F.col("patient_name")))
    twice = F.pmod(parts[0].cast("long"), F.lit(COPIED_EVERY)) == 3
    bodies = [line([F.col(field_of[normalize_header(h)]) if normalize_header(h) in field_of else F.lit("S1") for h in hs]) for hs in styles]
    body = rows.select(export_file(parts[3]).alias("source_file"), F.lit(1).alias("kind"), F.col("row_id").alias("key"),
                       F.explode(F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
                       styled(parts[3].cast("long"), bodies).alias("value"))
    return heads.unionByName(body)


def write_export_folder(spark: SparkSession, sf_dir: str, path: str) -> str:
    """The supplier exports as a folder of CSV text, one file per supplier; returns ``path``."""
    lines = export_lines(spark, sf_dir).repartition("source_file").sortWithinPartitions("source_file", "kind", "key", "copy")
    lines.select("source_file", "value").write.partitionBy("source_file").text(path)
    return path


WRONG_SOURCE_EVERY, WRONG_FIELD_EVERY = 13, 17


def folder_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviewers' overrides, and wrong ones by rules on the supplier key: an unknown header, an unknown field."""
    sup = table(spark, sf_dir, "supplier").select(export_file(F.col("s_suppkey")).alias("source_file"), "s_suppkey")
    wrong_source = sup.where(F.pmod("s_suppkey", F.lit(WRONG_SOURCE_EVERY)) == 5).select("source_file", F.lit("No Such Header").alias("source"), F.lit("ndc").alias("destination"))
    wrong_field = sup.where(F.pmod("s_suppkey", F.lit(WRONG_FIELD_EVERY)) == 6).select("source_file", F.lit("ndc").alias("source"), F.lit("colour").alias("destination"))
    return export_manual_overrides(spark, sf_dir).unionByName(wrong_source).unionByName(wrong_field)


AMBIGUOUS_STYLE = 4
MANUAL_OVERRIDE = ("Qty Dispensed", "quantity_billed")


def export_file(suppkey: Column) -> Column:
    return F.concat(F.lit("billing_supplier_"), suppkey.cast("string"), F.lit(".csv"))


def export_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_file, dataset_type, position, header): one billing export per supplier."""
    styles = export_header_styles()
    sup = table(spark, sf_dir, "supplier").select("s_suppkey")
    style = F.pmod(F.col("s_suppkey"), F.lit(len(styles)))
    arr = None
    for i, hs in enumerate(styles):
        lit = F.array(*[F.lit(h) for h in hs])
        arr = F.when(style == i, lit) if arr is None else arr.when(style == i, lit)
    return sup.select(export_file(F.col("s_suppkey")).alias("source_file"),
                      F.lit("billing").alias("dataset_type"),
                      F.posexplode(arr).alias("position", "header"))


def export_manual_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewer's override for every ambiguous-style export: which quantity column to use."""
    styles = export_header_styles()
    sup = table(spark, sf_dir, "supplier").select("s_suppkey")
    return sup.filter(F.pmod(F.col("s_suppkey"), F.lit(len(styles))) == AMBIGUOUS_STYLE).select(
        export_file(F.col("s_suppkey")).alias("source_file"),
        F.lit(MANUAL_OVERRIDE[0]).alias("source"), F.lit(MANUAL_OVERRIDE[1]).alias("destination"))


def ordering_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordering as a raw string export with planted defects (validation of the second rule set)."""
    li = _lineitem_with(spark, sf_dir, {"drug_name"}, "O", "p_name")
    key = _record_key()
    ok, pk, sk = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    ship = F.to_date("l_shipdate")
    style = F.pmod(pk, F.lit(len(EXPORT_DATE_STYLES)))
    date_text = None
    for i, fmt in enumerate(EXPORT_DATE_STYLES):
        date_text = (F.when(style == i, F.date_format(ship, fmt)) if date_text is None
                     else date_text.when(style == i, F.date_format(ship, fmt)))
    qty = F.regexp_replace(F.col("l_quantity").cast("decimal(18,2)").cast("string"), r"[.]?0+$", "")
    return li.select(
        key.alias("row_id"),
        F.when(F.pmod(ok, F.lit(BLANK_ID_EVERY)) == 0, F.lit(" ")).otherwise(key).alias("order_id"),
        F.lpad(pk.cast("string"), 11, "0").alias("ndc"),
        F.col("_part_value").alias("drug_name"),
        F.when(F.pmod(sk, F.lit(BAD_DATE_EVERY)) == 0, F.lit("31/31/2000")).otherwise(date_text)
        .alias("ordered_date"),
        F.when(F.pmod(pk, F.lit(NEGATIVE_EVERY)) == 1, F.concat(F.lit("-"), qty)).otherwise(qty)
        .alias("quantity_ordered"),
    )
