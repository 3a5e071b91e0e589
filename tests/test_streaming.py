"""Streaming jobs: duplicate suppression across micro-batches."""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

from millrate.schemas import ATTEMPTS
from millrate.session import scratch_path
from millrate.streaming import payments as stream

D = _dt.date
M = Decimal


def test_dedupe_across_micro_batches(spark):
    src = scratch_path(spark, "t-dedupe-src")
    batches = [
        [(1, "P-1", M("10.00"), D(2025, 3, 1), "11", None),
         (2, "P-2", M("20.00"), D(2025, 3, 2), "12", None)],
        [(3, "P-1", M("10.00"), D(2025, 3, 5), "11", None),   # repeat of 1, later batch
         (4, "P-3", M("30.00"), D(2025, 3, 6), "13", None)],
        [(5, "P-2", M("20.00"), D(2025, 3, 9), "12", None),   # repeat of 2
         (6, "P-2", M("21.00"), D(2025, 3, 9), "12", None)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ATTEMPTS).coalesce(1).write.parquet(f"{src}/part={i}")
    sink = scratch_path(spark, "t-dedupe-out")
    stream.stream_dedupe(spark, f"{src}/part=*", sink, scratch_path(spark, "t-dedupe-ckpt"),
                         max_files_per_trigger=1)
    got = sorted((r["parcel_id"], r["check_number"], r["amount"])
                 for r in spark.read.parquet(sink).collect())
    assert got == [("P-1", "11", M("10.00")), ("P-2", "12", M("20.00")),
                   ("P-2", "12", M("21.00")), ("P-3", "13", M("30.00"))]


def _write_batches(spark, src, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ATTEMPTS).coalesce(1).write.parquet(f"{src}/part={i}")


def test_old_dates_and_cash_installments_are_kept(spark):
    src, sink = scratch_path(spark, "t-dedupe-src"), scratch_path(spark, "t-dedupe-out")
    _write_batches(spark, src, [
        [(1, "P-1", M("10.00"), D(2025, 3, 1), "11", None), (2, "P-1", M("50.00"), D(2025, 3, 1), "CASH", 1)],
        [(3, "P-1", M("10.00"), D(1994, 3, 1), "12", None), (4, "P-1", M("50.00"), D(2025, 4, 1), "CASH", 2)],
        [(5, "P-1", M("10.00"), D(1993, 3, 1), "13", None), (6, "P-1", M("50.00"), D(2025, 4, 1), "CASH", 2)],
        [(4, "P-1", M("50.00"), D(2025, 4, 1), "CASH", 2), (7, "P-1", M("10.00"), D(1990, 1, 1), "12", None)]])
    stream.stream_dedupe(spark, f"{src}/part=*", sink, scratch_path(spark, "t-dedupe-ckpt"),
                         max_files_per_trigger=1)
    got = spark.read.schema(ATTEMPTS).parquet(sink).collect()
    checks = sorted(r["check_number"] for r in got if r["check_number"] != "CASH")
    assert checks == ["11", "12", "13"]
    assert sorted(r["seq"] for r in got if r["check_number"] == "CASH") == [2, 4, 6]


def test_every_attempt_reaches_one_output(spark, ledger):
    """Several batches, newest dates first; a month is closed between two."""
    attempts = ledger.attempts.orderBy("seq").limit(120).collect()
    attempts.sort(key=lambda r: r["date"], reverse=True)
    rows = [tuple(r) for r in attempts]
    rows[5] = (rows[5][0], "X-NOT-ON-ROLL", *rows[5][2:])
    src = scratch_path(spark, "t-pay-src")
    _write_batches(spark, src, [rows[:40], rows[40:80], rows[80:]])
    sinks = [scratch_path(spark, f"t-pay-{n}") for n in ("journal", "refused", "unknown")]
    calls = []

    def locks():
        calls.append(1)
        months = [(r["date"].replace(day=1),) for r in attempts] if len(calls) > 2 else []
        return spark.createDataFrame(months, "lock_month date")

    stream.stream_payments(spark, f"{src}/part=*", ledger.roll, locks, *sinks,
                           scratch_path(spark, "t-pay-ckpt"), max_files_per_trigger=1)
    journal, refused, unknown = (spark.read.parquet(s) for s in sinks)
    assert len(calls) == 3
    assert unknown.select("parcel_id").first()[0] == "X-NOT-ON-ROLL" and unknown.count() == 1
    ids = [r[0] for r in journal.select("transaction_id").collect()] + [
        r[0] for r in refused.select("transaction_id").collect()] + [r[0] for r in unknown.select("seq").collect()]
    assert sorted(ids) == sorted(r[0] for r in rows)
    assert refused.filter("transaction_type = 'REJECTED_PAYMENT'").count() == 0
    assert {r["seq"] for r in attempts[80:]} >= {r[0] for r in refused.select("transaction_id").collect()}
