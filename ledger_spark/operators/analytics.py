"""Billing analytics next to the inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_spark.operators.reconcile import MEDICATION_KEY, QUANTITY_DECIMAL

UNKNOWN = "UNKNOWN"
INSURANCE_KEY = (*MEDICATION_KEY, "insurance_name", "bin_number")
PATIENT_DETAIL_COLUMNS = (
    "patient_id", "patient_name", "date_of_birth", "prescription_id", "ndc",
    "drug_name", "insurance_name", "bin_number", "billing_date",
    "quantity_billed", "days_supply", "refills_remaining",
)


def _billed_sum() -> Column:
    return F.sum(F.col("quantity_billed").cast(QUANTITY_DECIMAL)).cast("double")


def insurance_billing_summary(billing_in_period: DataFrame, sort: bool = True,
                              names: DataFrame | None = None) -> DataFrame:
    """Billed quantity and distinct patients per medication, insurer and BIN.

    Missing insurer / BIN become ``UNKNOWN`` so the totals still add up to the
    inventory's billed totals.  A blank string is a value, not missing.  With a
    product master ``names`` the rows need only ``ndc``; names are attached
    after aggregation (see ``reconcile.reconcile_inventory``).
    """
    data = billing_in_period.fillna(UNKNOWN, subset=["insurance_name", "bin_number"])
    key = INSURANCE_KEY if names is None else tuple(k for k in INSURANCE_KEY if k != "drug_name")
    out = data.groupBy(*key).agg(
        _billed_sum().alias("total_billed"),
        F.countDistinct("patient_id").alias("unique_patient_count"),
    )
    if names is not None:
        out = out.join(names.select("ndc", "drug_name"), "ndc", "left").select(
            *INSURANCE_KEY, "total_billed", "unique_patient_count")
    return out.orderBy(*INSURANCE_KEY) if sort else out


def patient_medication_summary(billing_in_period: DataFrame, sort: bool = True,
                               names: DataFrame | None = None) -> DataFrame:
    """Distinct patients and billed quantity per medication."""
    key = MEDICATION_KEY if names is None else ("ndc",)
    out = billing_in_period.groupBy(*key).agg(
        F.countDistinct("patient_id").alias("unique_patient_count"),
        _billed_sum().alias("total_billed"),
    )
    if names is not None:
        out = out.join(names.select("ndc", "drug_name"), "ndc", "left").select(
            *MEDICATION_KEY, "unique_patient_count", "total_billed")
    return out.orderBy(*MEDICATION_KEY) if sort else out


def patient_billing_details(billing_in_period: DataFrame) -> DataFrame:
    """One row per billing record, 12 display columns."""
    return billing_in_period.select(*PATIENT_DETAIL_COLUMNS)


def medication_filter(ndc: str, drug_name: str | None = None) -> Column:
    """Drill-down predicate on the medication key."""
    cond = F.col("ndc") == F.lit(ndc)
    if drug_name is not None:
        cond = cond & (F.col("drug_name") == F.lit(drug_name))
    return cond


def selection_patient_count(details: DataFrame) -> DataFrame:
    """Distinct patients of the current selection (E5)."""
    return details.agg(F.countDistinct("patient_id").alias("unique_patients"))


def medication_pick_list(inventory: DataFrame) -> DataFrame:
    """``drug (ndc)`` labels in inventory order."""
    label = F.concat(F.coalesce(F.col("drug_name"), F.lit("")), F.lit(" ("),
                     F.coalesce(F.col("ndc"), F.lit("")), F.lit(")"))
    return (inventory.select(*MEDICATION_KEY, label.alias("label")).distinct()
            .orderBy(*MEDICATION_KEY))


def conservation_check(insurance: DataFrame, inventory: DataFrame) -> DataFrame:
    """Insurance totals must equal inventory billed totals per medication.

    One row: medications compared and how many disagree (expected 0).
    """
    ins = insurance.groupBy(*MEDICATION_KEY).agg(
        F.sum(F.col("total_billed").cast(QUANTITY_DECIMAL)).alias("insurance_total"))
    inv = inventory.filter(F.col("total_billed") > 0).select(
        *MEDICATION_KEY, F.col("total_billed").cast(QUANTITY_DECIMAL).alias("inventory_total"))
    cond = [ins[k].eqNullSafe(inv[k]) for k in MEDICATION_KEY]
    both = ins.join(inv, cond, "full")
    mismatch = ~F.coalesce(F.col("insurance_total"), F.lit(0)).eqNullSafe(
        F.coalesce(F.col("inventory_total"), F.lit(0)))
    return both.agg(F.count(F.lit(1)).alias("medications"),
                    F.count_if(mismatch).alias("mismatched_medications"))
