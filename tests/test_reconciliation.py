"""Inventory, coverage and billing analytics against the rules worked out row by row in plain Python."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledger_spark.operators import analytics as an
from ledger_spark.operators import reconcile as rc

FIRST, LAST = dt.date(2023, 2, 10), dt.date(2023, 3, 20)
BILLING = ("billing_id string, patient_id string, ndc string, drug_name string, billing_date date, insurance_name string, "
           "bin_number string, quantity_billed double")
ORDERS = "order_id string, ndc string, drug_name string, ordered_date date, quantity_ordered double"


def random_day(rng):
    """Days around both borders, on them, and none at all."""
    return rng.choice([None, FIRST, LAST, FIRST - dt.timedelta(days=1), LAST + dt.timedelta(days=1),
                       FIRST + dt.timedelta(days=rng.randrange(38))])


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(11)
    drugs = [("70", "Larch gel"), ("70", "Larch drops"), ("81", "Alder syrup"), (None, "Loose item"), ("92", None), ("93", "Only ordered"),
             ("94", "Only billed"), ("95", "Even")]
    billing = [(f"k{i}", rng.choice(["u", "v", "w", None]), *rng.choice([d for d in drugs if d[0] != "93"]), random_day(rng),
                rng.choice(["Payer 1", "Payer 2", "", None]), rng.choice(["7", None]), rng.choice([0.5, 1.25, 3.0, 12.0])) for i in range(160)]
    orders = [(f"p{i}", *rng.choice([d for d in drugs if d[0] not in ("94", "95")]), random_day(rng), rng.choice([0.25, 2.0, 9.0])) for i in range(90)]
    billing += [("even1", "u", "95", "Even", FIRST, "Payer 1", "7", 0.1), ("even2", "v", "95", "Even", LAST, "Payer 2", "7", 0.2)]
    already = sum(b[7] for b in billing if b[2] == "95" and b[4] and FIRST <= b[4] <= LAST)
    return billing, [*orders, ("even", "95", "Even", LAST, round(already, 4))]


@pytest.fixture(scope="module")
def period(spark, tables):
    billing, orders = tables
    return rc.reconcile_inventory(spark.createDataFrame(billing, BILLING), spark.createDataFrame(orders, ORDERS), FIRST, LAST.isoformat())


def inside(day):
    return day is not None and FIRST <= day <= LAST


def plain_totals(tables):
    totals = defaultdict(lambda: [0.0, 0.0])
    for _, _, ndc, drug, day, _, _, quantity in tables[0]:
        if inside(day):
            totals[ndc, drug][0] += quantity
    for _, ndc, drug, day, quantity in tables[1]:
        if inside(day):
            totals[ndc, drug][1] += quantity
    return {k: (round(b, 4), round(o, 4)) for k, (b, o) in totals.items()}


def test_inventory_is_the_plain_difference(period, tables):
    got = {(r.ndc, r.drug_name): r for r in period.inventory.collect()}
    want = plain_totals(tables)
    assert set(got) == set(want) and {r.status for r in got.values()} == {"MATCHED", "SHORT", "EXTRA"}
    for key, (billed, ordered) in want.items():
        r, net = got[key], round(ordered - billed, 4)
        assert (r.total_billed, r.total_ordered, round(r.net_difference, 4)) == (billed, ordered, net)
        assert (round(r.short_quantity, 4), round(r.extra_quantity, 4)) == (max(-net, 0), max(net, 0))
        assert r.status == ("MATCHED" if net == 0 else "SHORT" if net < 0 else "EXTRA")
    assert got["95", "Even"].status == "MATCHED"          # tenths that add up exactly only as decimals


def test_rows_come_in_order_of_code_and_name(period):
    keys = [(r.ndc is not None, r.ndc or "", r.drug_name is not None, r.drug_name or "") for r in period.inventory.collect()]
    assert keys == sorted(keys)


def test_coverage_counts_both_sides(period, tables):
    c, billing, orders = period.coverage.first(), *tables
    assert (c.billing_rows_total, c.billing_rows_in_period) == (len(billing), sum(inside(b[4]) for b in billing))
    assert (c.ordering_rows_total, c.ordering_rows_in_period) == (len(orders), sum(inside(o[3]) for o in orders))
    assert c.coverage_differs_materially is False


@pytest.mark.parametrize(("billed", "ordered", "differs"), [
    ([], [], False), ([3], [], True), ([], [3], True), ([1, 4], [4, 9], False), ([1, 2], [3, 4], True), ([5, 6], [1, 2], True)])
def test_coverage_differs_where_one_side_is_empty_or_the_dates_are_apart(spark, billed, ordered, differs):
    b = spark.createDataFrame([(FIRST + dt.timedelta(days=d),) for d in billed], "billing_date date")
    o = spark.createDataFrame([(FIRST + dt.timedelta(days=d),) for d in ordered], "ordered_date date")
    row = rc.period_coverage(b, o, FIRST, LAST).first()
    assert row.coverage_differs_materially is differs


def test_period_bounds(spark):
    assert rc.check_period("2023-02-10", dt.datetime(2023, 2, 10, 23, 59)) == (FIRST, FIRST)
    with pytest.raises(ValueError):
        rc.check_period(LAST, FIRST)


def test_payers_add_up_to_the_inventory(period, tables):
    by_payer = an.insurance_billing_summary(period.billing_in_period, sort=False)
    assert an.conservation_check(by_payer, period.inventory).first().mismatched_medications == 0
    names = {r.insurance_name for r in by_payer.collect()}
    assert names == {"Payer 1", "Payer 2", "", "UNKNOWN"}
    # without the rows of one payer, exactly the medications that it paid for no longer add up
    paid = {(b[2], b[3]) for b in tables[0] if inside(b[4]) and b[5] is None}
    lost = an.conservation_check(by_payer.where("insurance_name <> 'UNKNOWN'"), period.inventory).first()
    assert lost.mismatched_medications == len(paid) > 0


def test_analytics_reach_every_year(spark, sf_dir):
    from ledger_spark.plans import REGISTRY
    from ledger_spark.sources import derive
    billing = derive.billing(spark, sf_dir, ["ndc", "quantity_billed", "billing_date"])
    total, years = billing.agg(F.sum("quantity_billed"), F.countDistinct(F.year("billing_date"))).first()
    got = REGISTRY["e_insurance_summary_full"].build(spark, sf_dir).agg(F.sum("total_billed")).first()[0]
    assert years > 1 and float(got) == float(total)
    assert REGISTRY["e_patient_details_full"].build(spark, sf_dir).count() == billing.count()
    for name in ("patient_summary", "drilldown_insurance", "selection_patients", "pick_list", "conservation"):
        assert f"e_{name}" in REGISTRY and f"e_{name}_full" in REGISTRY
