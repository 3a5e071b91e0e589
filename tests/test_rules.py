"""Row rules on boundary dates, every validation code, NULLs and text."""

from __future__ import annotations

import datetime as _dt
import urllib.parse
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from brute_force import period as py_period
from brute_force import validate_one
from millrate.functions import rules, text

D = _dt.date


def _one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols))
    return df.select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("issue", [D(2025, 3, 1), D(2025, 12, 31), D(2024, 1, 31),
                                   D(2024, 12, 29), D(2023, 10, 31), D(2024, 2, 29)])
def test_period_boundaries(spark, issue):
    de = _one(spark, rules.discount_end(F.col("i")), i=issue)
    fe = _one(spark, rules.face_end(F.col("i")), i=issue)
    ps = _one(spark, rules.penalty_start(F.col("i")), i=issue)
    assert ps == fe + _dt.timedelta(days=1)
    for day in (issue - _dt.timedelta(days=3), de, de + _dt.timedelta(days=1), fe,
                fe + _dt.timedelta(days=1)):
        got = _one(spark, rules.payment_period(F.col("p"), F.col("i")), p=day, i=issue)
        assert got == py_period(day, issue), (issue, day)


def test_sample_deadlines(spark):
    issue = D(2025, 3, 1)
    assert _one(spark, rules.discount_end(F.col("i")), i=issue) == D(2025, 4, 30)
    assert _one(spark, rules.face_end(F.col("i")), i=issue) == D(2025, 6, 30)
    assert _one(spark, rules.penalty_start(F.col("i")), i=issue) == D(2025, 7, 1)


def test_null_issue_uses_default(spark):
    df = spark.createDataFrame([(D(2025, 4, 30), None), (D(2025, 5, 1), None)],
                               "p date, i date")
    got = [r[0] for r in df.select(rules.payment_period("p", "i")).collect()]
    assert got == ["DISCOUNT", "FACE"]


CASES = [
    # amount, postmark, plan, inst, expected code
    ("441.00", D(2025, 4, 15), False, None, "ACCEPTED_FULL"),
    ("450.00", D(2025, 5, 15), False, None, "ACCEPTED_FULL"),
    ("495.00", D(2025, 7, 15), False, None, "ACCEPTED_FULL"),
    ("440.99", D(2025, 4, 15), False, None, "REJECTED_UNDER"),
    ("450.00", D(2025, 4, 15), False, None, "REJECTED_OVER"),
    ("150.00", D(2025, 5, 20), True, 1, "ACCEPTED_INSTALLMENT"),
    ("150.00", D(2025, 7, 10), True, None, "REJECTED_INSTALLMENT_LATE"),
    ("150.00", D(2025, 7, 10), True, 1, "REJECTED_INSTALLMENT_LATE"),
    ("150.00", D(2025, 7, 20), True, 3, "ACCEPTED_INSTALLMENT"),
    ("165.00", D(2025, 7, 20), True, 2, "ACCEPTED_INSTALLMENT_PENALTY"),
    ("165.00", D(2025, 4, 20), True, None, "ACCEPTED_INSTALLMENT_PENALTY"),
    ("0.00", D(2025, 4, 20), False, None, "REJECTED_UNDER"),
    ("-5.00", D(2025, 4, 20), False, None, "REJECTED_UNDER"),
    ("441.00", D(2025, 4, 20), True, 1, "ACCEPTED_FULL"),
]


def test_every_validation_code(spark):
    rows = [(Decimal(a), d, p, i) for a, d, p, i, _ in CASES]
    df = spark.createDataFrame(rows, "amount decimal(18,2), d date, plan boolean, inst int")
    df = df.withColumn("face", F.lit(Decimal("450.00")).cast("decimal(18,2)")) \
        .withColumn("disc", F.lit(Decimal("441.00")).cast("decimal(18,2)")) \
        .withColumn("pen", F.lit(Decimal("495.00")).cast("decimal(18,2)")) \
        .withColumn("issue", F.lit(D(2025, 3, 1)))
    per = rules.payment_period("d", "issue")
    exp = rules.expected_amount(per, "disc", "face", "pen")
    code = rules.validation_code("amount", per, exp, "face", "plan", "inst")
    got = [r[0] for r in df.select(code).collect()]
    assert got == [c[-1] for c in CASES]
    parcel = {"face": Decimal("450.00"), "discount": Decimal("441.00"),
              "penalty": Decimal("495.00"), "issue": D(2025, 3, 1)}
    for (a, d, p, i, want), g in zip(CASES, got):
        assert validate_one({**parcel, "plan": p}, Decimal(a), d, i) == want == g


def test_installment_rounding_half_up(spark):
    # 450.15 / 3 = 150.05; x 1.10 = 165.055 -> 165.06 (HALF_UP, not float rounding)
    v = _one(spark, rules.installment_penalty_amount(F.col("f").cast("decimal(18,2)")),
             f=Decimal("450.15"))
    assert v == Decimal("165.06")


def test_messages_literal_and_corrected(spark):
    df = spark.createDataFrame(
        [("REJECTED_OVER", Decimal("460.00"), Decimal("450.00"), None),
         ("REJECTED_UNDER", Decimal("440.99"), Decimal("441.00"), None),
         ("ACCEPTED_INSTALLMENT", Decimal("150.00"), Decimal("450.00"), None),
         ("ACCEPTED_INSTALLMENT_PENALTY", Decimal("165.00"), Decimal("495.00"), None),
         ("ACCEPTED_INSTALLMENT", Decimal("150.00"), Decimal("450.00"), 2)],
        "code string, amt decimal(18,2), exp decimal(18,2), n int")
    lit = [r[0] for r in df.select(text.validation_message("code", "amt", "exp", "n")).collect()]
    assert lit[0] == "OVERPAYMENT of $10.0. Do not deposit. Issue Refund/Return Check."
    assert lit[1] == "UNDERPAYMENT of $0.01. Exact amount required or valid installment."
    assert lit[2] == "Exact Match (Installment 1)"
    assert lit[3] == "Exact Match (Penalty Installment None)"
    assert lit[4] == "Exact Match (Installment 2)"
    cor = [r[0] for r in df.select(
        text.validation_message("code", "amt", "exp", "n", "corrected")).collect()]
    assert cor[0] == "OVERPAYMENT of $10.00. Do not deposit. Issue Refund/Return Check."


def test_plain_reason_order(spark):
    df = spark.createDataFrame(
        [("UNDERPAYMENT of $1.0. Exact amount required or valid installment. (REJECTED_UNDER)",),
         ("OVERPAYMENT of $1.0. (REJECTED_OVER)",),
         ("Installment plan invalid during Penalty Period. (REJECTED_INSTALLMENT_LATE)",),
         ("something else",)], "r string")
    assert [r[0] for r in df.select(text.plain_reason_key("r")).collect()] == ["A", "B", "C", "D"]


def test_memo_parcel(spark):
    df = spark.createDataFrame([("2025 tax P-010",), ("  P-7 and P-8 ",), ("XP-1 only",),
                                ("no parcel",), (None,)], "m string")
    got = [r[0] for r in df.select(text.parcel_from_memo("m")).collect()]
    assert got == ["P-010", "P-7", text.UNKNOWN_PARCEL, text.UNKNOWN_PARCEL, text.UNKNOWN_PARCEL]


def test_mailto_matches_python_quote(spark):
    subject = "Tax Inquiry - Parcel P-001/a~b*c+d"
    body = "Hello,\n\n[ ] Receipt: #1 & 50% (ok)\nThank you,\nJane O'Neil"
    got = _one(spark, text.mailto_link("c@example.com", F.col("s"), F.col("b")),
               s=subject, b=body)
    want = ("mailto:c@example.com?subject=" + urllib.parse.quote(subject)
            + "&body=" + urllib.parse.quote(body))
    assert got == want


def test_money_and_audit_text(spark):
    assert _one(spark, text.money_text(F.col("x")), x=Decimal("1234.5")) == "$1,234.50"
    assert _one(spark, text.money_text(F.col("x")), x=Decimal("-450")) == "$-450.00"
    f = text.audit_line_fields(F.col("t"), F.col("f"), F.col("o"), F.col("n"))
    df = spark.createDataFrame([("2025-07-01T09:30:00.123456", None, "", "PAID")],
                               "t string, f string, o string, n string")
    r = df.select(*[v.alias(k) for k, v in f.items()]).first()
    assert (r["time"], r["field"], r["old"], r["new"]) == ("2025-07-01 09:30:00", "-", "-", "PAID")


def test_history_note(spark):
    df = spark.createDataFrame([("1001", "x"), ("CASH", "y"), (None, None), ("", "z")],
                               "c string, n string")
    got = [r[0] for r in df.select(rules.history_note("c", "n")).collect()]
    assert got == ["Ck#1001 x", "y", "", "z"]


def test_label_slot(spark):
    df = spark.range(0, 61).withColumnRenamed("id", "n")
    slot = rules.label_slot("n")
    rows = df.select("n", *[v.alias(k) for k, v in slot.items()]).collect()
    assert (rows[0]["page"], rows[0]["label_row"], rows[0]["label_col"]) == (1, 0, 0)
    assert (rows[29]["page"], rows[29]["label_row"], rows[29]["label_col"]) == (1, 9, 2)
    assert (rows[30]["page"], rows[30]["label_row"], rows[30]["label_col"]) == (2, 0, 0)
    assert rows[4]["x_in"] == pytest.approx(0.1875 + 2.75 + 0.1)


def test_status_event_rows(spark):
    df = spark.createDataFrame(
        [("PAYMENT", Decimal("0.00")), ("PAYMENT", Decimal("300.00")), ("RETURN", None),
         ("EXONERATION", None), ("NSF_REVERSAL", Decimal("450.00")),
         ("REJECTED_PAYMENT", Decimal("450.00"))], "t string, b decimal(18,2)")
    cor = [r[0] for r in df.select(rules.status_event("t", "b")).collect()]
    assert cor == ["PAID", "PARTIAL", "RETURNED", "EXONERATED", "UNPAID", None]
    lit = [r[0] for r in df.select(rules.status_event("t", "b", "literal")).collect()]
    assert lit == [None, None, "RETURNED", "EXONERATED", "UNPAID", None]
