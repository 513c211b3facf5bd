"""References between fills and prescriptions: unknown, repeated and unused ones."""

import datetime as dt

import pytest

from ledger_spark.operators import features as fe
from ledger_spark.operators import integrity as ig

FILLS = ("fill_id string, fill_date date, patient_id string, prescription_id string, medication_id string, ndc string, quantity_billed double, "
         "days_supply int, refill_number int, refills_remaining int")
RX = "prescription_id string, patient_id string, medication_id string, ndc string, prescription_date date, refills_authorized int"


def day(n):
    return dt.date(2022, 4, 1) + dt.timedelta(days=n)


def tables(spark, prescriptions):
    fills = [(f"q{i}", day(20 * i), "u", f"r{i // 2}", "m", "n", 1.0, 20, i % 2, 1 - i % 2) for i in range(6)]
    return spark.createDataFrame(fills, FILLS), spark.createDataFrame([(r, "u", "m", "n", d, 1) for r, d in prescriptions], RX)


def test_counts_and_reference_rows(spark):
    fills, rx = tables(spark, [("r0", day(0)), ("r0", day(9)), ("r0", day(9)), ("r2", day(81)), ("spare", day(1))])
    row = ig.violations(fills, rx).first()
    # r1 is unknown: no chronology fault, but both its fills miss their accounting; r2 is dated after its first fill
    assert tuple(row) == (1, 2, 2)
    assert {tuple(r) for r in ig.reference_issues(fills, rx).collect()} == {
        ("r1", "unknown_prescription", 2), ("r0", "repeated_prescription", 2), ("spare", "prescription_without_fill", 1)}
    assert ig.reference_issues(*tables(spark, [(f"r{i}", day(40 * i)) for i in range(3)])).count() == 0


def test_repeated_and_unknown_prescriptions_raise_in_features(spark):
    sound = [(f"r{i}", day(40 * i)) for i in range(3)]
    assert fe.candidate_features(*tables(spark, sound)).count() == 6
    with pytest.raises(Exception, match="More than one row of prescription r1"):
        fe.candidate_features(*tables(spark, [*sound, sound[1]])).collect()
    with pytest.raises(Exception, match="Unknown prescription"):
        fe.candidate_features(*tables(spark, sound[:2])).collect()


def _counted(spark, rows):
    """``rows`` with a look at each row counted."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    return rows.mapInArrow(look, rows.schema), seen


def test_prescriptions_are_derived_once(spark):
    fills, rx = tables(spark, [("r0", day(0)), ("r0", day(9)), ("r2", day(81)), (None, day(1)), (None, day(2)), ("spare", day(1)), ("spare", day(1))])
    rx, seen = _counted(spark, rx)
    odd = spark.createDataFrame([("z0", day(0), "u", None, "m", "n", 1.0, 20, 0, 1), ("z1", None, "u", "r0", "m", "n", 1.0, 20, None, None),
                                 ("z2", day(0), "u", "r0", "m", "n", 1.0, 20, 0, None), ("z3", day(0), "u", "r9", "m", "n", 1.0, 20, 0, None)], FILLS)
    # r1 is unknown (2 fills), z0 has none, z2 states none where 1 is expected; z1 states none and none is expected
    assert tuple(ig.violations(fills.unionByName(odd), rx).first()) == (1, 4, 3)
    assert seen.value == 7
    assert tuple(ig.violations(fills, rx.limit(0)).first()) == (0, 6, 0)
    assert tuple(ig.violations(fills.limit(0), rx).first()) == (0, 0, 3)


def test_planted_faults_come_from_one_reading_of_the_fills(spark):
    from ledger_spark.plans.eval_queries import planted_prescriptions
    # patient 1: missing; 2: also one without fills; 3: twice; 5: late; 36 (2 mod 17, 1 mod 7): only the one without fills
    fills = spark.createDataFrame([(f"q{n}", day(0), f"PT-{n}", f"PT-{n}/m/0", "m", "n", 1.0, 20, 0, 2) for n in (1, 2, 3, 5, 36)], FILLS)
    fills, seen = _counted(spark, fills)
    got = sorted((r.prescription_id, r.prescription_date) for r in planted_prescriptions(fills).collect())
    assert got == [("PT-2/m/0", day(0)), ("PT-2/m/0/none", day(0)), ("PT-3/m/0", day(0)), ("PT-3/m/0", day(0)),
                   ("PT-36/m/0/none", day(0)), ("PT-5/m/0", day(40))]
    assert seen.value == 5
