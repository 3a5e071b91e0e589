"""Sinks: CSV titles, text documents, ledger layout and month close on files."""

from __future__ import annotations

import datetime as _dt
import glob
import os

from pyspark.sql import functions as F

from millrate.plans import collections as coll
from millrate.plans import documents
from millrate.session import scratch_path
from millrate.sinks import writers


def test_turnover_csv_titles(spark, ledger):
    path = scratch_path(spark, "t-turnover")
    writers.write_turnover(coll.turnover_report(ledger.parcels, 2025), path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["Parcel ID", "Owner Name", "Property Address", "Tax Year",
                            "Face Tax", "Penalty", "Total Amount Due"]
    assert back.count() == coll.turnover_report(ledger.parcels, 2025).count()


def test_deposit_slip_text_lines(spark, ledger):
    path = scratch_path(spark, "t-deposit")
    writers.write_text(coll.deposit_slip_text(ledger.journal), path)
    lines = spark.read.text(path).filter(F.col("value").startswith("DEPOSIT SLIP - ")).count()
    assert lines == coll.deposit_totals(ledger.journal).count()


def test_receipts_as_documents(spark, ledger):
    path = scratch_path(spark, "t-receipts")
    rec = documents.receipts(ledger.journal, ledger.parcels, _dt.datetime(2025, 1, 2, 3, 4, 5))
    writers.write_documents(rec, path)
    row = spark.read.parquet(path).first()
    assert row["file_name"].startswith("Receipt_P-") and "OFFICIAL TAX RECEIPT" in row["receipt_text"]
    assert "Date: 2025-01-02 03:04:05" in row["receipt_text"]


def test_ledger_layout_and_month_close_on_files(spark, ledger):
    src = scratch_path(spark, "t-ledger")
    writers.write_ledger(ledger.journal.withColumn("is_closed", F.lit(False)), src)
    months = sorted(os.path.basename(p) for p in glob.glob(f"{src.removeprefix('file:')}/receipt_month=*"))
    assert months and all(m.startswith("receipt_month=") for m in months)
    out = scratch_path(spark, "t-ledger-closed")
    closures = spark.createDataFrame([(1, 1998), (2, 1998)], "month int, year int")
    n = writers.close_month_partitions(spark, src, closures, out)
    assert n == spark.read.parquet(src).filter("receipt_month in (date'1998-01-01', date'1998-02-01')").count()
    both = writers.read_version(spark, src, out)
    assert both.count() == ledger.journal.count() and both.filter("is_closed").count() == n
    written = sorted(os.path.basename(p) for p in glob.glob(f"{out.removeprefix('file:')}/receipt_month=*"))
    assert written == ["receipt_month=1998-01-01", "receipt_month=1998-02-01"]
    closed = spark.read.parquet(out)
    expect = spark.read.parquet(src).filter(
        F.col("receipt_month").isin(_dt.date(1998, 1, 1), _dt.date(1998, 2, 1))).count()
    assert closed.count() == expect and closed.filter(~F.col("is_closed")).count() == 0
    # The source version is untouched.
    assert spark.read.parquet(src).filter("is_closed").count() == 0


def test_monthly_detail_and_return_list_csv(spark, ledger):
    from millrate.plans import monthly
    detail = monthly.monthly_detail(ledger.journal, ledger.parcels, 4, 1998)
    path = scratch_path(spark, "t-monthly-csv")
    writers.write_csv(detail, path)
    back = spark.read.option("header", True).csv(path)
    assert back.count() == detail.count() > 0
    assert "tax_type" in back.columns and "amount_paid" in back.columns
    ret = coll.return_list(ledger.parcels)
    path = scratch_path(spark, "t-return-csv")
    writers.write_csv(ret, path)
    back = spark.read.option("header", True).csv(path)
    assert back.count() == ret.count()
    assert set(r["status"] for r in back.select("status").distinct().collect()) <= {"UNPAID",
                                                                                   "PARTIAL"}


def test_scratch_csv_is_compressed(spark, ledger):
    import __spark_entry__ as entry
    from millrate.plans import monthly
    detail = monthly.monthly_detail(ledger.journal, ledger.parcels)
    back = entry.q_monthly_csv(ledger)
    assert back.inputFiles() and all(f.endswith(".csv.gz") for f in back.inputFiles())
    assert back.schema.simpleString() == detail.schema.simpleString()
    assert back.count() == detail.count() and back.exceptAll(detail).isEmpty()
    assert entry.LEDGER_QUERIES["turnover_csv"](ledger).count() == ledger.parcels.filter(
        F.col("status").isin("UNPAID", "PARTIAL")).count()
