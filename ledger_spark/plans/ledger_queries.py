"""Registered reconciliation and billing-analytics queries (D, E)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledger_spark.operators import analytics as an
from ledger_spark.operators import reconcile as rc
from ledger_spark.plans.oracle import BILLING, ORDERING, with_
from ledger_spark.plans.registry import register
from ledger_spark.sources import derive

# Query parameters: the whole data range, and one calendar year inside it.
FULL_START, FULL_END = dt.date(1992, 1, 1), dt.date(2001, 12, 31)
YEAR_START, YEAR_END = dt.date(1998, 1, 1), dt.date(1998, 12, 31)
DRILL_NDC = "00000000001"

INVENTORY_COLS = ("ndc", "drug_name", "billing_date", "quantity_billed")
ORDER_COLS = ("ndc", "drug_name", "ordered_date", "quantity_ordered")
QTY = ("total_billed", "total_ordered", "net_difference", "short_quantity", "extra_quantity")


def _reconcile(spark, sf_dir, start, end, billing_cols=INVENTORY_COLS):
    """Names come from the product master after aggregation (the oracle joins per row)."""
    b = derive.billing(spark, sf_dir, [c for c in billing_cols if c != "drug_name"])
    o = derive.ordering(spark, sf_dir, [c for c in ORDER_COLS if c != "drug_name"])
    return rc.reconcile_inventory(b, o, start, end, names=derive.medication_names(spark, sf_dir))


def _inventory_sql(start: dt.date, end: dt.date) -> str:
    return with_(BILLING, ORDERING, f"""
tagged AS (
  SELECT ndc, drug_name, CAST(quantity_billed AS DECIMAL(28,6)) AS b, CAST(0 AS DECIMAL(28,6)) AS o
  FROM billing WHERE billing_date BETWEEN DATE '{start}' AND DATE '{end}'
  UNION ALL
  SELECT ndc, drug_name, CAST(0 AS DECIMAL(28,6)), CAST(quantity_ordered AS DECIMAL(28,6))
  FROM ordering WHERE ordered_date BETWEEN DATE '{start}' AND DATE '{end}'
),
totals AS (SELECT ndc, drug_name, sum(b) AS tb, sum(o) AS tor FROM tagged GROUP BY ndc, drug_name)""") + """
SELECT ndc, drug_name, CAST(tb AS DOUBLE) AS total_billed, CAST(tor AS DOUBLE) AS total_ordered,
       CAST(tor - tb AS DOUBLE) AS net_difference,
       CAST(greatest(tb - tor, 0) AS DOUBLE) AS short_quantity,
       CAST(greatest(tor - tb, 0) AS DOUBLE) AS extra_quantity,
       CASE WHEN tor - tb < 0 THEN 'SHORT' WHEN tor - tb > 0 THEN 'EXTRA' ELSE 'MATCHED' END AS status
FROM totals ORDER BY ndc, drug_name"""


@register("d_inventory", _inventory_sql(FULL_START, FULL_END), QTY)
def d_inventory(spark, sf_dir):
    """Inventory over the whole data range: billed vs ordered per medication."""
    return _reconcile(spark, sf_dir, FULL_START, FULL_END).inventory


@register("d_inventory_1998", _inventory_sql(YEAR_START, YEAR_END), QTY)
def d_inventory_1998(spark, sf_dir):
    """Inventory for one calendar year; the window reaches the Parquet scan."""
    return _reconcile(spark, sf_dir, YEAR_START, YEAR_END).inventory


def _coverage_sql(start, end):
    return with_(BILLING, ORDERING) + f"""
, cov AS (
  SELECT (SELECT count(*) FROM billing) AS billing_rows_total,
         (SELECT count(*) FROM billing WHERE billing_date BETWEEN DATE '{start}' AND DATE '{end}') AS billing_rows_in_period,
         (SELECT count(*) FROM ordering) AS ordering_rows_total,
         (SELECT count(*) FROM ordering WHERE ordered_date BETWEEN DATE '{start}' AND DATE '{end}') AS ordering_rows_in_period,
         (SELECT min(billing_date) FROM billing WHERE billing_date BETWEEN DATE '{start}' AND DATE '{end}') AS billing_date_min,
         (SELECT max(billing_date) FROM billing WHERE billing_date BETWEEN DATE '{start}' AND DATE '{end}') AS billing_date_max,
         (SELECT min(ordered_date) FROM ordering WHERE ordered_date BETWEEN DATE '{start}' AND DATE '{end}') AS ordered_date_min,
         (SELECT max(ordered_date) FROM ordering WHERE ordered_date BETWEEN DATE '{start}' AND DATE '{end}') AS ordered_date_max
)
SELECT DATE '{start}' AS start_date, DATE '{end}' AS end_date, *,
       CASE WHEN billing_date_min IS NULL OR ordered_date_min IS NULL
            THEN (billing_date_min IS NULL) <> (ordered_date_min IS NULL)
            ELSE billing_date_min > ordered_date_max OR ordered_date_min > billing_date_max
       END AS coverage_differs_materially
FROM cov"""


@register("d_coverage_1998", _coverage_sql(YEAR_START, YEAR_END),
          dates=("start_date", "end_date", "billing_date_min", "billing_date_max", "ordered_date_min", "ordered_date_max"))
def d_coverage_1998(spark, sf_dir):
    """Period coverage of both sides and the material-difference flag."""
    return _reconcile(spark, sf_dir, YEAR_START, YEAR_END).coverage


@register("d_date_bounds", with_(BILLING, ORDERING) + """
SELECT min(d) AS date_min, max(d) AS date_max FROM (
  SELECT billing_date AS d FROM billing UNION ALL SELECT ordered_date FROM ordering) u""",
            dates=("date_min", "date_max"))
def d_date_bounds(spark, sf_dir):
    """Earliest and latest date over both exports."""
    return rc.available_date_bounds(derive.billing(spark, sf_dir, ["billing_date"]),
                                    derive.ordering(spark, sf_dir, ["ordered_date"]))


def _billing_year_sql(select: str) -> str:
    return with_(BILLING) + f"""
, bp AS (SELECT * FROM billing WHERE billing_date BETWEEN DATE '{YEAR_START}' AND DATE '{YEAR_END}')
{select}"""


def _billing_period(spark, sf_dir, cols, start, end):
    b = derive.billing(spark, sf_dir, cols)
    return rc.filter_period(b, "billing_date", start, end)


def _register_e(name: str, year_sql: str, doubles=(), **kinds):
    """Register a builder over (start, end) twice: ``name`` reads one year, ``name``_full the whole data range."""
    full_sql = (year_sql.replace(f"DATE '{YEAR_START}'", f"DATE '{FULL_START}'")
                .replace(f"DATE '{YEAR_END}'", f"DATE '{FULL_END}'"))

    def wrap(fn):
        for suffix, sql, start, end in (("", year_sql, YEAR_START, YEAR_END), ("_full", full_sql, FULL_START, FULL_END)):
            def build(spark, sf_dir, start=start, end=end):
                return fn(spark, sf_dir, start, end)
            build.__name__, build.__doc__ = name + suffix, fn.__doc__
            register(name + suffix, sql, doubles, **kinds)(build)
        return fn
    return wrap


INSURANCE_SQL = """
SELECT ndc, drug_name, coalesce(insurance_name, 'UNKNOWN') AS insurance_name,
       coalesce(bin_number, 'UNKNOWN') AS bin_number,
       CAST(sum(CAST(quantity_billed AS DECIMAL(28,6))) AS DOUBLE) AS total_billed,
       count(DISTINCT patient_id) AS unique_patient_count
FROM bp GROUP BY 1, 2, 3, 4 ORDER BY 1, 2, 3, 4"""


@_register_e("e_insurance_summary", _billing_year_sql(INSURANCE_SQL), ["total_billed"])
def e_insurance_summary(spark, sf_dir, start, end):
    """Billed quantity and distinct patients per medication, insurer, BIN."""
    b = _billing_period(spark, sf_dir, ["ndc", "insurance_name", "bin_number",
                                       "quantity_billed", "patient_id", "billing_date"], start, end)
    return an.insurance_billing_summary(b, names=derive.medication_names(spark, sf_dir))


@_register_e("e_patient_summary", _billing_year_sql("""
SELECT ndc, drug_name, count(DISTINCT patient_id) AS unique_patient_count,
       CAST(sum(CAST(quantity_billed AS DECIMAL(28,6))) AS DOUBLE) AS total_billed
FROM bp GROUP BY 1, 2 ORDER BY 1, 2"""), ["total_billed"])
def e_patient_summary(spark, sf_dir, start, end):
    """Distinct patients and billed quantity per medication."""
    b = _billing_period(spark, sf_dir, ["ndc", "quantity_billed", "patient_id", "billing_date"], start, end)
    return an.patient_medication_summary(b, names=derive.medication_names(spark, sf_dir))


@_register_e("e_patient_details", _billing_year_sql(
    "SELECT " + ", ".join(an.PATIENT_DETAIL_COLUMNS) + " FROM bp"), ["quantity_billed"],
              dates=("date_of_birth", "billing_date"), nullable_ints=("refills_remaining",))
def e_patient_details(spark, sf_dir, start, end):
    """One row per billing record in the period, 12 display columns."""
    return an.patient_billing_details(_billing_period(spark, sf_dir, derive.BILLING_COLUMNS, start, end))


@_register_e("e_drilldown_insurance", _billing_year_sql(
    f"SELECT * FROM ({INSURANCE_SQL}) WHERE ndc = '{DRILL_NDC}'"), ["total_billed"])
def e_drilldown_insurance(spark, sf_dir, start, end):
    """Insurance rows of one medication (E4 drill-down on the medication key)."""
    b = _billing_period(spark, sf_dir, ["ndc", "insurance_name", "bin_number",
                                       "quantity_billed", "patient_id", "billing_date"], start, end)
    return an.insurance_billing_summary(b.filter(an.medication_filter(DRILL_NDC)),
                                        names=derive.medication_names(spark, sf_dir))


@_register_e("e_selection_patients", _billing_year_sql(
    f"SELECT count(DISTINCT patient_id) AS unique_patients FROM bp WHERE ndc = '{DRILL_NDC}'"))
def e_selection_patients(spark, sf_dir, start, end):
    """Distinct patients of the drill-down selection (E5)."""
    b = _billing_period(spark, sf_dir, ["ndc", "patient_id", "billing_date"], start, end)
    return an.selection_patient_count(b.filter(an.medication_filter(DRILL_NDC)))


@_register_e("e_pick_list", _inventory_sql(YEAR_START, YEAR_END).replace(
    "FROM totals ORDER BY ndc, drug_name",
    "FROM totals) SELECT DISTINCT ndc, drug_name, "
    "coalesce(drug_name, '') || ' (' || coalesce(ndc, '') || ')' AS label "
    "FROM inv ORDER BY ndc, drug_name").replace(
    "SELECT ndc, drug_name, CAST(tb AS DOUBLE)", ", inv AS (SELECT ndc, drug_name, CAST(tb AS DOUBLE)"))
def e_pick_list(spark, sf_dir, start, end):
    """``drug (ndc)`` labels in inventory order."""
    return an.medication_pick_list(_reconcile(spark, sf_dir, start, end).inventory)


def _conservation_sql(payers: str) -> str:
    return _billing_year_sql(f"""
, per_payer AS (SELECT ndc, drug_name, coalesce(insurance_name, 'UNKNOWN') AS payer, coalesce(bin_number, 'UNKNOWN') AS bin,
                       sum(CAST(quantity_billed AS DECIMAL(28,6))) AS t FROM bp GROUP BY 1, 2, 3, 4)
, ins AS (SELECT ndc, drug_name, sum(t) AS t FROM per_payer WHERE {payers} GROUP BY 1, 2)
, inv AS (SELECT ndc, drug_name, sum(CAST(quantity_billed AS DECIMAL(28,6))) AS t FROM bp GROUP BY 1, 2)
SELECT count(*) AS medications, count(*) FILTER (WHERE coalesce(ins.t, 0) <> inv.t) AS mismatched_medications
FROM inv LEFT JOIN ins ON ins.ndc IS NOT DISTINCT FROM inv.ndc AND ins.drug_name IS NOT DISTINCT FROM inv.drug_name""")


@_register_e("e_conservation", _conservation_sql("true"))
def e_conservation(spark, sf_dir, start, end):
    """Insurance totals equal inventory billed totals per medication."""
    rec = _reconcile(spark, sf_dir, start, end)
    b = _billing_period(spark, sf_dir, ["ndc", "drug_name", "insurance_name", "bin_number",
                                       "quantity_billed", "patient_id", "billing_date"], start, end)
    ins = an.insurance_billing_summary(b, sort=False)
    return an.conservation_check(ins, rec.inventory)


@_register_e("e_conservation_known_payers", _conservation_sql("payer <> 'UNKNOWN'"))
def e_conservation_known_payers(spark, sf_dir, start, end):
    """The same check against named payers only: medications with unnamed payers do not add up."""
    rec = _reconcile(spark, sf_dir, start, end)
    b = _billing_period(spark, sf_dir, ["ndc", "drug_name", "insurance_name", "bin_number",
                                       "quantity_billed", "patient_id", "billing_date"], start, end)
    named = an.insurance_billing_summary(b, sort=False).filter(F.col("insurance_name") != an.UNKNOWN)
    return an.conservation_check(named, rec.inventory)
