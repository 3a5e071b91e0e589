"""Rows that must neither vanish nor change on their way: undated attempts,
rows without a type, equal requests, payments without a number, odd search
terms, and outputs of a stream that fails between two writes."""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrate.functions import rules
from millrate.operators import maintenance, posting, replay
from millrate.plans import intake, lookup
from millrate.schemas import ATTEMPTS, JOURNAL
from millrate.session import scratch_path
from millrate.sources.extraction import parse_check_extractions
from millrate.streaming import payments as stream
from test_robust_input import parcel

D, M = _dt.date, Decimal


def attempts(spark, *rows):
    """(seq, parcel, amount, date) of attempts."""
    names = [f.name for f in ATTEMPTS.fields]
    made = [dict(zip(("seq", "parcel_id", "amount", "date"), r)) | {"check_number": str(r[0])} for r in rows]
    return spark.createDataFrame([tuple(m.get(n) for n in names) for m in made], ATTEMPTS)


def journal(spark, *rows):
    names = [f.name for f in JOURNAL.fields]
    base = {"date_received": D(2025, 4, 1), "amount_paid": M("98.00"), "is_closed": False, "parcel_id": "P-1"}
    return spark.createDataFrame([tuple((base | r).get(n) for n in names) for r in rows], JOURNAL)


ROWS = [(1, "P-1", M("110.00"), None), (2, "P-1", M("98.00"), D(2025, 4, 1)), (3, "X", M("1.00"), None),
        (4, "P-1", M("5.00"), D(2025, 4, 1))]


def test_an_undated_attempt_has_no_price(spark):
    roll = parcel(spark, "P-1")
    a = attempts(spark, *ROWS)
    posted = posting.post_payments(a, roll).collect()
    assert {(r["transaction_id"], r["transaction_type"]) for r in posted} == {
        (2, "PAYMENT"), (4, "REJECTED_PAYMENT")}
    assert [r["seq"] for r in posting.undated_attempts(a, roll).collect()] == [1]
    assert [r["seq"] for r in posting.unknown_parcels(a, roll).collect()] == [3]
    period = spark.createDataFrame([(None,)], "p string").select(
        rules.expected_amount("p", F.lit(1), F.lit(2), F.lit(3)).alias("x"))
    assert period.first()["x"] is None


def test_replay_takes_no_undated_payment(spark):
    names = ("seq long, command string, parcel_id string, amount decimal(18,2), date date, check_number string, "
             "installment_num int, reason string, tx_id long, month int, year int")
    rows = [(s, "pay", p, m, d, None, None, None, None, None, None) for s, p, m, d in ROWS]
    kept, refused = replay.replay(spark.createDataFrame(rows, names), parcel(spark, "P-1"))
    assert sorted(r["transaction_id"] for r in kept.collect()) == [2, 4] and refused.count() == 0


def test_a_row_without_a_type_keeps_to_the_lock(spark):
    rows = journal(spark, *({"transaction_id": i, "transaction_type": t} for i, t in enumerate(
        [None, "PAYMENT", "REJECTED_PAYMENT"])))
    locks = spark.createDataFrame([(D(2025, 4, 1),)], "lock_month date")
    allowed, refused = posting.split_by_lock_table(rows, locks)
    assert [r["transaction_id"] for r in allowed.collect()] == [2]
    assert sorted(r["transaction_id"] for r in refused.collect()) == [0, 1]


def test_every_interim_request_has_an_answer(spark):
    def ask(seq, owner, pid="P-9"):
        return (seq, pid, owner, "1 Rd", M("10.00"), M("100.00"), M("98.00"), M("110.00"), D(2025, 6, 1))

    rows = [ask(1, "Bo"), ask(1, "Al"), ask(1, "Al"), ask(2, "Cy"), ask(1, "Di", "P-1"), ask(1, "Di", "P-1")]
    new = spark.createDataFrame(rows, "seq long, parcel_id string, owner_name string, property_address string, "
                                      "assessment_value decimal(18,2), face_tax_amount decimal(18,2), "
                                      "discount_amount decimal(18,2), penalty_amount decimal(18,2), "
                                      "bill_issue_date date")
    roll, rejected = maintenance.add_interim(parcel(spark, "P-1"), new)
    assert {(r["parcel_id"], r["owner_name"]) for r in roll.collect()} == {("P-1", "Ann"), ("P-9", "Al")}
    got = sorted((r["parcel_id"], r["owner_name"], r["reason"]) for r in rejected.collect())
    assert got == [("P-1", "Di", "already exists"), ("P-1", "Di", "duplicate request"),
                   ("P-9", "Al", "duplicate request"), ("P-9", "Bo", "duplicate request"),
                   ("P-9", "Cy", "duplicate request")]


def test_payments_without_a_number_can_repeat(spark):
    rows = journal(spark, *({"transaction_id": i, "transaction_type": "PAYMENT", "check_number": c}
                            for i, c in enumerate([None, None, "CASH", "CASH", "7", "7", "8"])))
    got = intake.duplicate_payments(rows).collect()
    assert {(r["check_number"], r["times_recorded"]) for r in got} == {(None, 2), ("7", 2)}


@pytest.mark.parametrize("term,owner", [("a\\b", "xA\\By"), ("\\", "end\\"), ("50%_x", "50 plus 1x"), ("\\%", "\\")])
def test_terms_with_a_backslash(spark, term, owner):
    roll = parcel(spark, "P-1", "P-2").withColumn(
        "owner_name", F.when(F.col("parcel_id") == "P-2", F.lit(owner)).otherwise(F.lit("Ann")))
    assert [r["parcel_id"] for r in lookup.find_parcel(roll, term).collect()] == ["P-2"]


@pytest.mark.parametrize("text,fine", [
    ('{"amount": 1.0}', True), ('{"amount": 1.0} {"x": 1}', False), ('{"amount": 1.0},{"x": 1}', False),
    ('{"amount": 1.0}] [{"x": 1}', False), ('{"amount": 1.0}} , {"w": {"x": 1}', False),
    ('{"amount": 1.0, "memo": "} {"}', True), (' {"amount": 1.0}\n', True)])
def test_one_object_spans_the_text(spark, text, fine):
    got = parse_check_extractions(spark.createDataFrame([(1, text)], "extraction_id long, raw_text string")).first()
    assert got["parse_ok"] is fine


def test_a_crash_between_two_writes(spark):
    roll = parcel(spark, "P-1")
    src = scratch_path(spark, "t-crash-src")
    attempts(spark, *ROWS).coalesce(1).write.parquet(f"{src}/part=0")
    names = ("journal", "refused", "unknown", "undated")
    sinks = {n: scratch_path(spark, f"t-crash-{n}") for n in names}
    checkpoint = scratch_path(spark, "t-crash-ckpt")
    none = spark.createDataFrame([], "lock_month date")
    broken = sinks | {"unknown": "nowhere://x"}

    def run(to):
        stream.stream_payments(spark, f"{src}/part=*", roll, lambda: none, to["journal"], to["refused"],
                               to["unknown"], checkpoint, to["undated"])

    with pytest.raises(Exception):
        run(broken)
    assert spark.read.parquet(sinks["journal"]).count() == 2  # written, but not published
    assert stream.read_published(spark, sinks["journal"], sinks["journal"]) is None
    run(sinks)
    counts = [stream.read_published(spark, sinks[n], sinks["journal"]).count() for n in names]
    assert counts == [2, 0, 1, 1] and sum(counts) == len(ROWS)
    assert spark.read.parquet(sinks["journal"]).count() == 2


def test_a_check_is_parsed_once_for_all_its_uses(spark):
    """Filters on the parsed columns repeat neither the date's parser nor the memo's split."""
    df = spark.createDataFrame([(1, '{"amount": 1.0, "postmark_date": "2025-03-01", "memo": "2025 tax P-7"}')],
                               "extraction_id long, raw_text string")
    rows = parse_check_extractions(df).filter(
        "parse_ok and found_parcel_id <> 'none' and postmark_date is not null and amount > 0")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert [plan.count(x) for x in ("try_to_date", "split(", "from_json(")] == [1, 1, 3]
    assert rows.first()["found_parcel_id"] == "P-7"
