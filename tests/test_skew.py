"""A parcel holding a third of all attempts: results stay exact and the
hot parcel's running balance is computed across several tasks."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from millrate.operators.status import parcel_status, running_balance


def test_hot_parcel_running_balance_and_status(spark, ledger):
    roll = ledger.roll
    hot = roll.orderBy("parcel_id").first()["parcel_id"]
    journal = ledger.journal.withColumn(
        "parcel_id",
        F.when(F.col("transaction_id") % 3 == 0, F.lit(hot)).otherwise(F.col("parcel_id")))
    share = journal.filter(F.col("parcel_id") == hot).count() / journal.count()
    assert share > 0.3

    rb = running_balance(journal, roll, partitions=8)
    got = rb.filter(F.col("parcel_id") == hot).toPandas().sort_values(
        ["date_received", "transaction_id"])
    money = journal.filter((F.col("parcel_id") == hot)
                           & F.col("transaction_type").isin("PAYMENT", "NSF_REVERSAL")) \
        .toPandas().sort_values(["date_received", "transaction_id"])
    want = money["amount_paid"].cumsum()
    assert len(got) == len(money) > 100
    assert list(got["net_paid_to_date"]) == list(want)

    # The hot parcel's rows really were split over several range partitions.
    from millrate.operators.util import _ranged
    money_rows = journal.filter(F.col("transaction_type").isin("PAYMENT", "NSF_REVERSAL")) \
        .select("parcel_id", "date_received", "transaction_id")
    pieces = _ranged(money_rows, ["parcel_id", "date_received", "transaction_id"], 8)
    assert pieces.filter(F.col("parcel_id") == hot).select("_pid").distinct().count() > 1

    st = parcel_status(roll, journal).filter(F.col("parcel_id") == hot).first()
    pays = journal.filter(F.col("parcel_id") == hot).toPandas()
    net = pays.loc[pays["transaction_type"].isin(["PAYMENT", "NSF_REVERSAL"]),
                   "amount_paid"].sum()
    assert st["net_paid"] == Decimal(net)
    full = (pays["validation_code"] == "ACCEPTED_FULL").any()
    face = roll.filter(F.col("parcel_id") == hot).first()["face_tax_amount"]
    expected = "PAID" if full or net >= face else ("PARTIAL" if net > 0 else "UNPAID")
    assert st["status"] == expected
