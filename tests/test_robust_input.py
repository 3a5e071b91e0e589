"""Inputs that are valid or plausible but untidy."""

from __future__ import annotations

import datetime as _dt
import json
import os
import tempfile
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from brute_force import sequential_replay
from millrate import session
from millrate.operators import audit, maintenance, posting, replay
from millrate.operators.util import range_partitions
from millrate.plans import collections as coll
from millrate.plans import intake
from millrate.schemas import JOURNAL, PARCELS
from millrate.sinks import writers
from millrate.sources import fixtures
from millrate.sources.extraction import parse_check_extractions
from millrate.sources.roll_csv import read_labels, read_roll
from millrate.sources.tables import _fingerprint

D, M = _dt.date, Decimal
RUN = _dt.datetime(2025, 7, 1)


def parcel(spark, *ids):
    row = {"owner_name": "Ann", "face_tax_amount": M("100.00"), "discount_amount": M("98.00"),
           "penalty_amount": M("110.00"), "bill_issue_date": D(2025, 3, 1), "is_installment_plan": False,
           "is_interim": False, "status": "UNPAID"}
    return spark.createDataFrame([tuple((row | {"parcel_id": i}).get(f.name) for f in PARCELS.fields) for i in ids],
                                 PARCELS)


def texts(spark):
    good = {"check_number": "7", "amount": 98.0, "postmark_date": "2025-04-01", "memo": "2025 tax P-1"}
    made = [good, good | {"postmark_date": "April 20, 2025"}, good | {"amount": 1e30},
            {k: v for k, v in good.items() if k != "postmark_date"}, good | {"amount": "ten"}]
    return spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(made)] + [(9, "Sorry!"), (10, None)],
                                 "extraction_id long, raw_text string")


def test_bad_extractions_go_to_review(spark):
    rows = {r["extraction_id"]: r for r in parse_check_extractions(texts(spark)).collect()}
    assert {i for i, r in rows.items() if r["parse_ok"]} == {0, 3}
    roll = parcel(spark, "P-1")
    assert [r["transaction_id"] for r in intake.ingest_payments(texts(spark), roll).collect()] == [0]
    review = {r["extraction_id"]: r["review_reason"] for r in intake.review_queue(texts(spark), roll).collect()}
    assert review == {1: "UNPARSABLE", 2: "UNPARSABLE", 3: "NO_POSTMARK_DATE", 4: "UNPARSABLE", 9: "UNPARSABLE",
                      10: "UNPARSABLE"}
    dated = intake.ingest_payments(texts(spark), roll, D(2025, 4, 2)).collect()
    assert {r["transaction_id"]: r["payment_period"] for r in dated} == {0: "DISCOUNT", 3: "DISCOUNT"}


def test_undated_rows_fail_loudly(spark):
    asked = spark.createDataFrame([(1, "P-1", M("5.00"), None, "x")],
                                  "seq long, parcel_id string, amount decimal(18,2), date date, reason string")
    with pytest.raises(PySparkException, match="date_received is required"):
        posting.exonerate(asked).collect()


def test_csv_as_the_csv_module_reads_it(spark):
    folder = tempfile.mkdtemp()
    path = os.path.join(folder, "roll.csv")
    head = ("parcel_id,owner_name,property_address,bill_number,assessment_value,face_tax_amount,"
            "discount_amount,penalty_amount,tax_type")
    tail = ",1 St,B1,1000,100,98,110,Real Estate"
    with open(path, "w") as f:
        f.write(head + "\n" + 'P-1,"Ann ""A"" Lee, Jr"' + tail + "\n" + 'P-2,"Bo\nDo"' + tail + "\n" + "P-1,Last" + tail + "\n")
    rows = read_roll(spark, path)
    assert [r["owner_name"] for r in rows.orderBy("row_no").collect()] == ['Ann "A" Lee, Jr', "Bo\nDo", "Last"]
    roll = maintenance.upsert_parcels(parcel(spark, "P-2", "P-3"), rows)
    assert {r["parcel_id"]: r["owner_name"] for r in roll.collect()} == {
        "P-1": "Last", "P-2": "Bo\nDo", "P-3": "Ann"}
    labels = spark.createDataFrame([('A "B", C', "1 St\nTown")], "name string, address string")
    out = session.scratch_path(spark, "t-labels")
    writers.write_labels_csv(labels, out)
    assert [tuple(r) for r in read_labels(spark, out).select("name", "address").collect()] == [('A "B", C', "1 St\nTown")]


def journal(spark, rows):
    names = [f.name for f in JOURNAL.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], JOURNAL)


def payment(i, **more):
    return {"transaction_id": i, "date_received": D(2025, 4, 1), "parcel_id": "P-1", "transaction_type": "PAYMENT",
            "payment_method": "CHECK", "check_number": "7", "amount_paid": M("50.00"),
            "balance_remaining": M("0.00"), "is_closed": False, "payment_period": "FACE"} | more


def test_one_reversal_for_one_payment(spark):
    asked = spark.createDataFrame([(11, 1, D(2025, 5, 1)), (10, 1, D(2025, 5, 2)), (12, 5, D(2025, 5, 2))],
                                  "seq long, transaction_id long, date date")
    j = journal(spark, [payment(1)])
    rows, missing = posting.nsf_reversals(j, asked)
    assert [r["transaction_id"] for r in rows.collect()] == [10]
    assert sorted(r["new_id"] for r in missing.collect()) == [11, 12]
    rows, missing = posting.nsf_reversals(j, asked, "literal")
    assert sorted(r["transaction_id"] for r in rows.collect()) == [10, 11]


def test_cash_and_rejected_rows_are_no_duplicates(spark):
    rows = [payment(1), payment(2), payment(3, check_number="CASH", payment_method="CASH"),
            payment(4, check_number="CASH", payment_method="CASH"),
            payment(5, installment_number=2), payment(6, transaction_type="REJECTED_PAYMENT")]
    got = intake.duplicate_payments(journal(spark, rows)).collect()
    assert [(r["check_number"], r["times_recorded"], r["first_transaction_id"]) for r in got] == [("7", 2, 1)]


def test_audit_tail_is_newest_first(spark):
    log = audit.journal_insert_log(journal(spark, [payment(i) for i in (9, 10, 11, 12)]), RUN)
    assert [r["record_id"] for r in audit.audit_tail(log, 2).collect()] == ["12", "11"]


def test_deposit_slip_matches_the_printed_table(spark):
    import pandas as pd
    rows = [payment(1, amount_paid=M("100.00")), payment(2, check_number="1234567890123", amount_paid=M("33.50")),
            payment(3, date_received=D(2025, 4, 2), amount_paid=M("1234.25"))]
    got = coll.deposit_slip_text(journal(spark, rows)).orderBy("date_received", "section", "line_id").collect()
    for day, mine in ((D(2025, 4, 1), rows[:2]), (D(2025, 4, 2), rows[2:])):
        lines = [r["value"] for r in got if r["date_received"] == day]
        table = pd.DataFrame([(r["check_number"], float(r["amount_paid"]), r["parcel_id"]) for r in mine],
                             columns=["check_number", "amount_paid", "parcel_id"]).to_string(index=False)
        assert lines[0] == f"DEPOSIT SLIP - {day}" and lines[4:] == table.split("\n")


def test_status_report_without_payments(spark):
    roll, none = parcel(spark, "P-1"), journal(spark, [])
    lines = coll.status_report_lines(coll.status_kpis(roll, none), coll.status_breakdown(roll),
                                     coll.status_by_tax_type(roll, none), RUN).collect()
    assert lines[-1]["line"] == "| (No Payments Yet) | - | - |"


COMMANDS = ("seq long, command string, parcel_id string, amount decimal(18,2), date date, check_number string, "
            "installment_num int, tx_id long, reason string, month int, year int")


def run_replay(spark, commands, semantics):
    names = [c.split()[0] for c in COMMANDS.split(", ")]
    frame = spark.createDataFrame([tuple(c.get(n) for n in names) for c in commands], COMMANDS)
    kept, refused = replay.replay(frame, parcel(spark, "P-1"), semantics)
    model = {"P-1": {"issue": D(2025, 3, 1), "discount": M("98.00"), "face": M("100.00"), "penalty": M("110.00")}}
    want, gone = sequential_replay(commands, model, semantics)
    assert {r["transaction_id"]: r["transaction_type"] for r in kept.collect()} == {
        i: r["type"] for i, r in want.items()}
    assert sorted(r["transaction_id"] for r in refused.collect()) == sorted(gone)
    return want


def pay(seq, date, amount="98.00"):
    return {"seq": seq, "command": "pay", "parcel_id": "P-1", "amount": M(amount), "date": date, "check_number": "7"}


def test_a_reversal_can_be_reversed_literally(spark):
    commands = [pay(1, D(2025, 4, 1)), {"seq": 2, "command": "nsf", "tx_id": 1, "date": D(2025, 4, 5)},
                {"seq": 3, "command": "nsf", "tx_id": 2, "date": D(2025, 4, 9)}]
    assert set(run_replay(spark, commands, "literal")) == {1, 2, 3}
    assert set(run_replay(spark, commands, "corrected")) == {1, 2}


def test_long_chains_of_reversals_settle(spark):
    """Each reversal is the first row of the next month, whose close then refuses
    the payment that the next reversal names."""
    commands, seq = [], 1
    month = lambda k: D(2024 - k // 12, 12 - k % 12, 1)
    commands.append(pay(seq, D(2025, 4, 1)))
    last = seq
    for k in range(12):
        first = month(k)
        commands += [
            {"seq": seq + 1, "command": "nsf", "tx_id": last, "date": first},
            {"seq": seq + 2, "command": "close_month", "month": first.month, "year": first.year},
            pay(seq + 3, first)]
        last = seq + 3
        seq += 3
    run_replay(spark, commands, "corrected")


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"
        applicationId = "x"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_partitions_follow_the_input(spark, monkeypatch):
    from millrate.operators import util
    path = session.scratch_path(spark, "t-ranges")
    spark.range(10_000).write.parquet(path)
    df = spark.read.parquet(path)
    assert range_partitions(df) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(util, "RANGE_BYTES", 1000)
    assert range_partitions(df) > 20


def test_rewritten_files_change_the_fingerprint(spark):
    folder = session.scratch_path(spark, "t-inputs")
    for name in ("orders", "customer", "lineitem"):
        spark.range(3).write.parquet(f"{folder}/{name}.parquet")
    before = _fingerprint(spark, folder)
    assert before == _fingerprint(spark, folder)
    spark.range(4).write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    assert before != _fingerprint(spark, folder)


def test_too_many_lines_in_an_order_fail(spark):
    folder = session.scratch_path(spark, "t-hot-order")
    base = "/root/testdata/sf0.001"
    line = spark.read.parquet(f"{base}/lineitem.parquet")
    one = line.limit(1)
    spark.range(600).crossJoin(one).drop("id").write.parquet(f"{folder}/lineitem.parquet")
    roll = parcel(spark, "P-" + str(one.first()["l_orderkey"])).withColumn("x", F.lit(1)).drop("x")
    with pytest.raises(PySparkException, match="over 499 lines"):
        fixtures.attempts_from_lineitem(spark, folder, roll).agg(F.max("seq")).collect()
