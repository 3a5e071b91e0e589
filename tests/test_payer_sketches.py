"""Stored sketches of paying parcels, merged over months."""

import datetime as dt

from millrate.plans import monthly


def _detail(spark, rows):
    return spark.createDataFrame(rows, "receipt_month date, tax_type string, transaction_type string, parcel_id string")


def test_a_parcel_of_several_months_counts_once(spark):
    m1, m2 = dt.date(2025, 1, 1), dt.date(2025, 2, 1)
    rows = [(m1, "Fire", "PAYMENT", "P-1")] * 3 + [(m2, "Fire", "PAYMENT", "P-1"), (m2, "Fire", "PAYMENT", "P-2"),
            (m2, None, "PAYMENT", "P-3"), (m2, "Fire", "RETURN", "P-4"), (m2, "Fire", "PAYMENT", None)]
    kept = monthly.payer_sketches(_detail(spark, rows))
    assert {tuple(r) for r in monthly.payers_of(kept, "receipt_month", "tax_type").collect()} == {
        (m1, "Fire", 1), (m2, "Fire", 2), (m2, None, 1)}
    assert {tuple(r) for r in monthly.payers_of(kept, "tax_type").collect()} == {("Fire", 2), (None, 1)}
    assert monthly.payers_of(kept).collect()[0][0] == 3


def test_batches_of_a_month_merge(spark):
    """Sketches of two halves of the rows, merged, count parcels of both halves once."""
    rows = [(dt.date(2025, 1 + i % 5, 1), "Fire", "PAYMENT", f"P-{i // 2}") for i in range(40_000)]
    halves = monthly.payer_sketches(_detail(spark, rows[::2])).unionByName(
        monthly.payer_sketches(_detail(spark, rows[1::2])))
    whole = monthly.payer_sketches(_detail(spark, rows))
    for kept in (halves, whole):
        assert abs(monthly.payers_of(kept).collect()[0][0] - 20_000) <= 600


def test_no_rows(spark):
    kept = monthly.payer_sketches(_detail(spark, []))
    assert kept.isEmpty() and monthly.payers_of(kept, "tax_type").isEmpty()
