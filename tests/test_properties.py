"""Properties: conservation of attempts, change log replays to the new
snapshot, and the validation rule against the Python model on random input."""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brute_force import validate_one
from millrate.functions import rules
from millrate.operators import audit, maintenance, posting
from millrate.sources import fixtures

D = _dt.date


def test_attempts_are_conserved(spark, ledger):
    att = fixtures.orphan_attempts(ledger.attempts)
    posted = posting.post_payments(att, ledger.roll)
    unknown = posting.unknown_parcels(att, ledger.roll)
    assert posted.count() + unknown.count() == att.count()
    allowed, refused = posting.split_by_month_lock(posted, ledger.journal)
    assert allowed.count() + refused.count() == posted.count()
    assert refused.filter(F.col("transaction_type") == "REJECTED_PAYMENT").count() == 0


def test_change_log_applied_to_before_gives_after(spark, ledger):
    before = ledger.parcels
    k = F.regexp_extract("parcel_id", r"^P-(\d+)$", 1).try_cast("long")
    patches = before.filter(k % 5 == 0).select(
        "parcel_id", F.upper("owner_name").alias("new_name"),
        F.when(k % 2 == 0, F.lit("9 Elm St")).alias("new_address"), k.alias("seq"))
    after, _ = maintenance.update_parcels(before, patches)
    fields = ["owner_name", "mailing_address"]
    log = audit.change_log(before, after, "parcel_id", fields, "tax_duplicate",
                           _dt.datetime(2025, 1, 1))
    changes = log.groupBy("record_id").pivot("field_name", fields).agg(F.first("new_value"))
    rebuilt = before.join(changes.withColumnRenamed("record_id", "parcel_id")
                          .withColumnRenamed("owner_name", "_n")
                          .withColumnRenamed("mailing_address", "_a"), "parcel_id", "left") \
        .withColumn("owner_name", F.coalesce("_n", "owner_name")) \
        .withColumn("mailing_address", F.coalesce("_a", "mailing_address")) \
        .select(*before.columns)
    assert rebuilt.exceptAll(after.select(*before.columns)).count() == 0
    assert after.select(*before.columns).exceptAll(rebuilt).count() == 0


_cents = st.integers(min_value=-5_000, max_value=2_000_000)
_day = st.dates(min_value=D(1995, 1, 1), max_value=D(2003, 12, 31))
_case = st.tuples(_cents, _day, _day, st.booleans(), st.sampled_from([None, 0, 1, 2, 3]),
                  st.sampled_from(["face", "disc", "pen", "third", "third_pen", "any"]))


@settings(max_examples=5, deadline=None)
@given(st.lists(_case, min_size=50, max_size=200))
def test_validation_matches_python_model(spark, cases):
    rows = []
    for face_c, issue, postmark, plan, inst, pick in cases:
        face = Decimal(abs(face_c) + 300) / 100
        disc = (face * Decimal("0.98")).quantize(Decimal("0.01"))
        pen = (face * Decimal("1.10")).quantize(Decimal("0.01"))
        third = (face / 3).quantize(Decimal("0.01"), "ROUND_HALF_UP")
        amount = {"face": face, "disc": disc, "pen": pen, "third": third,
                  "third_pen": (third * Decimal("1.10")).quantize(Decimal("0.01"),
                                                                 "ROUND_HALF_UP"),
                  "any": Decimal(face_c) / 100}[pick]
        rows.append((face, disc, pen, issue, postmark, plan, inst, amount))
    df = spark.createDataFrame(rows, "face decimal(18,2), disc decimal(18,2), pen decimal(18,2), "
                                     "issue date, pm date, plan boolean, inst int, "
                                     "amt decimal(18,2)")
    per = rules.payment_period("pm", "issue")
    code = rules.validation_code("amt", per, rules.expected_amount(per, "disc", "face", "pen"),
                                 "face", "plan", "inst")
    got = [r[0] for r in df.select(code).collect()]
    want = [validate_one({"face": f, "discount": d, "penalty": p, "issue": i, "plan": pl},
                         a, pm, n) for f, d, p, i, pm, pl, n, a in rows]
    assert got == want
