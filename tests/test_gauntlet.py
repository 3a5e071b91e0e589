"""The full-year scenario replayed through the library (golden values)."""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrate.operators import audit, maintenance, posting
from millrate.operators.status import parcel_status
from millrate.plans import collections as coll
from millrate.plans import documents, lookup, monthly, settlement
from millrate.schemas import ATTEMPTS, JOURNAL_COLUMNS, PARCEL_COLUMNS, PARCELS

D = _dt.date
M = Decimal


def sample_roll(spark):
    """The 99-parcel demo roll (groups as in the reference's sample data)."""
    rows = []

    def add(i, face, disc, pen, ttype, issue, plan):
        pid = f"P-{i:03d}"
        mail = f"PO Box {i}" if i in (1, 2) else f"{i} Main St"
        rows.append((pid, f"Owner {i:03d}", f"{i} Main St", mail, f"B-{i:03d}", M("100000.00"),
                     M("0.00"), M("0.00"), M(face), M(disc), M(pen), ttype, issue, plan,
                     False, "UNPAID"))

    for i in range(1, 91):
        add(i, "450.00", "441.00", "495.00", "Real Estate", D(2025, 3, 1), False)
    for i in range(91, 96):
        add(i, "450.00", "441.00", "495.00", "Real Estate", D(2025, 3, 1), True)
    for i in (96, 97):
        add(i, "225.00", "220.50", "247.50", "Real Estate", D(2025, 7, 1), False)
    add(98, "45.00", "44.10", "49.50", "Per Capita", D(2025, 3, 1), False)
    add(99, "450.00", "441.00", "495.00", "Real Estate", D(2025, 3, 1), False)
    return spark.createDataFrame(rows, PARCELS)


PAYS = [  # seq, parcel, amount, date, check, installment
    (1, "P-001", "441.00", D(2025, 4, 15), "CASH", None),
    (2, "P-002", "450.00", D(2025, 5, 15), "2002", None),
    (3, "P-003", "495.00", D(2025, 7, 15), "CASH", None),
    (4, "P-004", "440.99", D(2025, 4, 15), "4004", None),
    (5, "P-005", "450.00", D(2025, 4, 10), "5005", None),
    (6, "P-096", "220.50", D(2025, 7, 15), "CASH", None),
    (7, "P-091", "150.00", D(2025, 5, 20), "9101", 1),
    (8, "P-010", "441.00", D(2025, 4, 20), "1001", None),
]
LATER_PAYS = [
    (11, "P-001", "10.00", D(2025, 4, 28), "CASH", None),  # closed month, rejected anyway
    (12, "P-091", "150.00", D(2025, 7, 10), "9102", None),
    (13, "P-091", "150.00", D(2025, 6, 10), "9103", 2),
    (14, "P-091", "150.00", D(2025, 7, 20), "9104", 3),
    (15, "P-005", "450.00", D(2025, 4, 25), "5006", None),
]


def attempts(spark, rows):
    return spark.createDataFrame([(s, p, M(a), d, c, i) for s, p, a, d, c, i in rows], ATTEMPTS)


@pytest.fixture(scope="module")
def scenario(spark):
    roll = sample_roll(spark)
    j1 = posting.post_payments(attempts(spark, PAYS), roll)
    april_before = monthly.monthly_detail(j1, roll, 4, 2025)
    closes = spark.createDataFrame([(4, 2025)], "month int, year int")
    j1 = posting.close_month(j1, closes)
    counts = posting.close_month_counts(
        posting.post_payments(attempts(spark, PAYS), roll), closes).first()
    exon = posting.exonerate(spark.createDataFrame(
        [(9, "P-098", M("45.00"), D(2025, 5, 10), "Senior exemption")],
        "seq long, parcel_id string, amount decimal(18,2), date date, reason string"))
    nsf, missing = posting.nsf_reversals(j1, spark.createDataFrame(
        [(10, 2, D(2025, 5, 25))], "seq long, transaction_id long, date date"))
    later = posting.post_payments(attempts(spark, LATER_PAYS), roll)
    journal = j1.unionByName(exon).unionByName(nsf).unionByName(later).select(*JOURNAL_COLUMNS)
    interim_req = spark.createDataFrame(
        [("P-INT-001", "New Owner", "1 New Rd", M("50000.00"), M("500.00"), M("490.00"),
          M("550.00"), D(2025, 8, 1), 1)],
        "parcel_id string, owner_name string, property_address string, assessment_value "
        "decimal(18,2), face_tax_amount decimal(18,2), discount_amount decimal(18,2), "
        "penalty_amount decimal(18,2), bill_issue_date date, seq long")
    roll2, rejects = maintenance.add_interim(roll, interim_req)
    return {"roll": roll2, "journal": journal.cache(), "april_before": april_before,
            "close_count": counts, "missing": missing, "rejects": rejects}


def test_journal_outcomes(scenario):
    j = {r["transaction_id"]: r for r in scenario["journal"].collect()}
    assert len(j) == 15
    assert (j[1]["transaction_type"], j[1]["payment_period"]) == ("PAYMENT", "DISCOUNT")
    assert j[2]["payment_period"] == "FACE" and j[3]["payment_period"] == "PENALTY"
    assert j[4]["validation_code"] == "REJECTED_UNDER"
    assert j[4]["notes"] == ("Rejected: UNDERPAYMENT of $0.01. Exact amount required or valid "
                             "installment. (REJECTED_UNDER)")
    assert j[4]["balance_remaining"] == M("450.00")
    assert j[5]["validation_code"] == "REJECTED_OVER"
    assert (j[7]["validation_code"], j[7]["installment_number"]) == ("ACCEPTED_INSTALLMENT", 1)
    assert j[8]["payment_method"] == "CHECK" and j[1]["payment_method"] == "CASH"
    assert j[10]["amount_paid"] == M("-450.00") and j[10]["balance_remaining"] == M("450.00")
    assert j[10]["notes"] == "NSF Reversal for Trans ID 2"
    assert j[12]["validation_code"] == "REJECTED_INSTALLMENT_LATE"
    assert (j[14]["payment_period"], j[14]["validation_code"]) == ("PENALTY", "ACCEPTED_INSTALLMENT")
    assert {k for k, r in j.items() if r["is_closed"]} == {1, 4, 5, 8}
    assert scenario["close_count"]["rows_closed"] == 4
    assert scenario["missing"].count() == 0
    assert scenario["rejects"].count() == 0


def test_april_report_before_close(spark, scenario):
    d = scenario["april_before"]
    lit = d.agg(F.count(F.lit(1)), F.sum("amount_paid")).first()
    assert (lit[0], lit[1]) == (4, M("1772.99"))
    cor = d.filter(F.col("transaction_type").isin("PAYMENT", "NSF_REVERSAL")) \
        .agg(F.count(F.lit(1)), F.sum("amount_paid")).first()
    assert (cor[0], cor[1]) == (2, M("882.00"))
    summ = monthly.monthly_summary(d).collect()
    assert [(r["tax_type"], r["payment_period"], r["amount"]) for r in summ] == \
        [("Real Estate", "DISCOUNT", M("882.00"))]
    lit_r = {r["recipient"]: r["amount"] for r in
             monthly.remittance_advice(d, types=None).collect()}
    assert lit_r["township"] == M("1418.3920")
    assert lit_r["county"] == M("265.9485")
    assert lit_r["school"] == M("88.6495")
    assert lit_r["TOTAL COLLECTED"] == M("1772.99")
    cor_r = {r["recipient"]: r["amount"] for r in monthly.remittance_advice(d).collect()}
    assert (cor_r["township"], cor_r["county"], cor_r["school"]) == \
        (M("705.60"), M("132.30"), M("44.10"))


def test_settlement_literal(scenario):
    s = settlement.settlement_literal(scenario["roll"], scenario["journal"]).first()
    assert s["original_face"] == M("43695.00") and s["interim_face"] == M("500.00")
    assert s["cash_collected"] == M("2497.50")
    assert s["discounts_allowed"] == M("22.50")
    assert s["penalties_collected"] == M("-255.00")
    assert s["exonerations"] == M("45.00")
    assert s["returned_face"] == M("44150.00")
    assert s["returned_penalty"] == M("48565.00")
    assert s["difference"] == M("-2775.00") and not s["balanced"]


def test_settlement_corrected(scenario):
    s = settlement.settlement(scenario["roll"], scenario["journal"]).first()
    assert s["original_face"] == M("43695.00") and s["interim_face"] == M("500.00")
    assert s["cash_collected"] == M("2047.50")
    assert s["discounts_allowed"] == M("22.50")
    assert s["penalties_collected"] == M("45.00")
    assert s["exonerations"] == M("45.00")
    assert s["returned_face"] == M("42125.00")
    assert s["returned_penalty"] == M("46337.50")
    assert s["difference"] == M("0.00") and s["balanced"]
    assert settlement.settlement_exceptions(scenario["roll"], scenario["journal"]).count() == 0


def test_status_corrected_and_literal(scenario):
    cor = {r["parcel_id"]: r["status"] for r in
           parcel_status(scenario["roll"], scenario["journal"]).collect()}
    assert {p for p, s in cor.items() if s == "PAID"} == {"P-001", "P-003", "P-096", "P-091",
                                                            "P-010"}
    assert cor["P-002"] == "UNPAID" and cor["P-098"] == "EXONERATED"
    lit = {r["parcel_id"]: r["status"] for r in
           parcel_status(scenario["roll"], scenario["journal"], "literal").collect()}
    assert {p for p, s in lit.items() if s != "UNPAID"} == {"P-098"}


def test_month_lock_refuses_late_april_payment(spark, scenario):
    late = posting.post_payments(attempts(spark, [
        (20, "P-020", "441.00", D(2025, 4, 28), "CASH", None),
        (21, "P-021", "1.00", D(2025, 4, 28), "CASH", None),
        (22, "P-022", "450.00", D(2025, 5, 28), "CASH", None)]), scenario["roll"])
    allowed, refused = posting.split_by_month_lock(late, scenario["journal"])
    assert sorted(r["transaction_id"] for r in refused.collect()) == [20]
    assert sorted(r["transaction_id"] for r in allowed.collect()) == [21, 22]


def test_interim_row(scenario):
    r = scenario["roll"].filter("parcel_id = 'P-INT-001'").select(*PARCEL_COLUMNS).first()
    assert r["is_interim"] and r["status"] == "UNPAID" and r["bill_number"] == "INT-P-INT-001"
    assert r["mailing_address"] == "1 New Rd" and r["tax_type"] == "Real Estate"


def test_paperwork_and_lookups(spark, scenario):
    roll, journal = scenario["roll"], scenario["journal"]
    parcels = parcel_status(roll, journal).select(*PARCEL_COLUMNS).cache()
    assert journal.filter("transaction_id = 11").first()["validation_code"] == "REJECTED_UNDER"
    # Receipt for transaction 1.
    rec = documents.receipts(journal, parcels, _dt.datetime(2025, 12, 1)).filter(
        "transaction_id = 1").first()
    assert rec["file_name"] == "Receipt_P-001_1.txt"
    assert "Amount Paid:    $441.00" in rec["receipt_text"] and "Status: PAID" in rec["receipt_text"]
    # Deposit slip for 2025-04-20: the one check of P-010.
    slip = coll.deposit_slip(journal).filter(F.col("date_received") == D(2025, 4, 20)).collect()
    assert [(r["check_number"], r["amount_paid"], r["parcel_id"]) for r in slip] == \
        [("1001", M("441.00"), "P-010")]
    # Return list and lien list: every open parcel (UNPAID incl. the interim bill).
    assert coll.return_list(parcels).count() == 94
    lien = {r["parcel_id"]: r for r in coll.turnover_report(parcels, 2025).collect()}
    assert len(lien) == 94 and lien["P-004"]["total_amount_due"] == M("945.00")
    # Bills for the whole roll; reprint of one bill is a filter.
    bills = documents.bill_run(parcels, "Township_County", D(2025, 3, 1))
    assert bills.count() == 100
    b1 = bills.filter("parcel_id = 'P-001'").first()
    assert b1["file_name"] == "Township_County_P-001_Bill_2025-03.pdf"
    assert (b1["discount_by"], b1["face_by"], b1["penalty_from"]) == ("Apr 30", "Jun 30", "Jul 01")
    assert documents.bill_run(parcels, semantics="literal").filter(
        "parcel_id = 'P-001'").first()["face_by"] == "May 01"
    # Status report and labels.
    lines = [r["line"] for r in coll.status_report_lines(
        coll.status_kpis(parcels, journal), coll.status_breakdown(parcels),
        coll.status_by_tax_type(parcels, journal), _dt.datetime(2025, 12, 1)).collect()]
    assert "*   **Total Parcels:** 100" in lines and "*   **PAID:** 5 parcels" in lines
    labels = {r["parcel_id"]: r for r in coll.mailing_labels(parcels).collect()}
    assert labels["P-001"]["address"] == "PO Box 1" and len(labels) == 100
    # Address change of P-005 and its audit trail.
    patch = spark.createDataFrame([("P-005", "", "77 New Address Rd", 1)],
                                  "parcel_id string, new_name string, new_address string, seq long")
    after, rejects = maintenance.update_parcels(parcels, patch)
    assert rejects.count() == 0
    log = audit.change_log(parcels, after, "parcel_id", ["owner_name", "mailing_address"],
                           "tax_duplicate", _dt.datetime(2025, 12, 1))
    tail = audit.audit_tail(log.unionByName(audit.journal_insert_log(
        journal, _dt.datetime(2025, 12, 1))), 20).collect()
    assert len(tail) == 16  # 1 address change + 15 journal inserts
    assert any(r["record_id"] == "P-005" and r["new"] == "77 New Address Rd" for r in tail)
    # Lookups: paid, installment plan paid in three parts, unpaid with amount due.
    p1 = lookup.lookup(parcels, "P-001", D(2025, 8, 1)).first()
    assert p1["status"] == "PAID" and p1["amount_due"] is None
    p91 = lookup.lookup(parcels, "P-091", D(2025, 8, 1)).first()
    assert p91["status"] == "PAID" and p91["installment_amount"] == M("150.00")
    p4 = lookup.lookup(parcels, "P-004", D(2025, 8, 1)).first()
    assert (p4["status"], p4["period_name"], p4["amount_due"]) == ("UNPAID", "PENALTY", M("495.00"))
    assert p4["status_message"].endswith("The total amount due TODAY is $495.00.")
    assert lookup.lookup(parcels, "owner 01", D(2025, 8, 1)).first()["parcel_id"] == "P-010"
    # The rejected P-005 attempts are in its history.
    hist = lookup.parcel_history(journal, parcels).filter("parcel_id = 'P-005'").collect()
    assert [(r["transaction_id"], r["transaction_type"]) for r in hist] == \
        [(5, "REJECTED_PAYMENT"), (15, "REJECTED_PAYMENT")]
    assert hist[0]["note"].startswith("Ck#5005 Rejected: OVERPAYMENT of $9.0.")
