"""Operators against brute force on small inputs, incl. a hot key."""

from __future__ import annotations

import datetime as _dt
import os
import tempfile
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from brute_force import sequential_replay
from millrate.operators import audit, maintenance, posting, replay
from millrate.operators.util import global_row_number, running_sum
from millrate.schemas import PARCEL_COLUMNS
from millrate.sources.roll_csv import RollLoadError, read_labels, read_roll

D = _dt.date
M = Decimal


def test_running_sum_hot_key_matches_pandas(spark):
    # One key holds a third of all rows; it must span several range partitions.
    rows = [("HOT" if i % 3 == 0 else f"K{i % 97}", i, (i * 7) % 13 - 4) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    out = running_sum(df, "k", ["t"], "v", "run", partitions=6).toPandas()
    ref = pd.DataFrame(rows, columns=["k", "t", "v"]).sort_values(["k", "t"])
    ref["run"] = ref.groupby("k")["v"].cumsum()
    merged = out.merge(ref, on=["k", "t", "v"], suffixes=("", "_ref"))
    assert len(merged) == len(rows)
    assert (merged["run"] == merged["run_ref"]).all()


def test_global_row_number_is_dense_and_ordered(spark):
    df = spark.createDataFrame([(f"P-{i:05d}",) for i in range(2500)][::-1], "parcel_id string")
    out = global_row_number(df, ["parcel_id"], "n", partitions=5) \
        .orderBy("n").toPandas()
    assert list(out["n"]) == list(range(1, 2501))
    assert list(out["parcel_id"]) == sorted(out["parcel_id"])


def _roll(spark, ids, status="UNPAID"):
    from millrate.schemas import PARCELS
    rows = [(p, f"Owner {p}", f"{p} Main St", f"{p} Main St", f"B{p}", M("1.00"), M("0"),
             M("0"), M("100.00"), M("98.00"), M("110.00"), "Real Estate", D(2025, 3, 1), False,
             False, status) for p in ids]
    return spark.createDataFrame(rows, PARCELS)


def test_upsert_last_wins_and_status_rules(spark):
    cur = _roll(spark, ["P-1", "P-2"], status="PAID")
    inc = _roll(spark, ["P-2", "P-2", "P-3"]).withColumn(
        "row_no", F.monotonically_increasing_id())
    inc = inc.withColumn("owner_name", F.concat(F.lit("v"), F.col("row_no").cast("string")))
    last_owner = inc.filter("parcel_id = 'P-2'").agg(F.max_by("owner_name", "row_no")).first()[0]
    cor = {r["parcel_id"]: r for r in maintenance.upsert_parcels(cur, inc).collect()}
    assert cor["P-2"]["owner_name"] == last_owner and cor["P-2"]["status"] == "PAID"
    assert cor["P-1"]["status"] == "PAID" and cor["P-3"]["status"] == "UNPAID"
    lit = {r["parcel_id"]: r for r in
           maintenance.upsert_parcels(cur, inc, semantics="literal").collect()}
    assert lit["P-2"]["status"] == "UNPAID"
    # Idempotent: applying the same file twice gives the same roll.
    once = maintenance.upsert_parcels(cur, inc)
    twice = maintenance.upsert_parcels(once, inc)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_update_parcels_and_change_log(spark):
    cur = _roll(spark, ["P-1", "P-2", "P-3"])
    patches = spark.createDataFrame(
        [("P-1", "New Name", "", 1), ("P-1", "", "9 Elm", 2), ("P-2", "", None, 3),
         ("P-9", "Ghost", None, 4)], "parcel_id string, new_name string, new_address string, seq long")
    after, rejects = maintenance.update_parcels(cur, patches)
    a = {r["parcel_id"]: r for r in after.collect()}
    assert (a["P-1"]["owner_name"], a["P-1"]["mailing_address"]) == ("New Name", "9 Elm")
    assert sorted(r["reason"] for r in rejects.collect()) == ["no field to update",
                                                              "parcel not found"]
    log = audit.change_log(cur, after, "parcel_id", ["owner_name", "mailing_address"],
                           "tax_duplicate", _dt.datetime(2025, 1, 1))
    got = sorted((r["record_id"], r["field_name"], r["old_value"], r["new_value"])
                 for r in log.collect())
    assert got == [("P-1", "mailing_address", "P-1 Main St", "9 Elm"),
                   ("P-1", "owner_name", "Owner P-1", "New Name")]
    tail = audit.audit_tail(log, 1).collect()
    assert len(tail) == 1 and tail[0]["time"] == "2025-01-01 00:00:00"


def test_add_interim_first_request_wins(spark):
    cur = _roll(spark, ["P-1"])
    req = spark.createDataFrame(
        [("P-1", "X", "1 A St", M("1"), M("5"), M("4"), M("6"), D(2025, 8, 1), 1),
         ("P-7", "Y", "7 A St", M("1"), M("5"), M("4"), M("6"), D(2025, 8, 1), 2),
         ("P-7", "Z", "8 A St", M("1"), M("5"), M("4"), M("6"), D(2025, 8, 1), 3)],
        "parcel_id string, owner_name string, property_address string, assessment_value "
        "decimal(18,2), face_tax_amount decimal(18,2), discount_amount decimal(18,2), "
        "penalty_amount decimal(18,2), bill_issue_date date, seq long")
    roll, rej = maintenance.add_interim(cur, req)
    r = {x["parcel_id"]: x for x in roll.collect()}
    assert r["P-7"]["owner_name"] == "Y" and r["P-7"]["is_interim"]
    assert sorted((x["parcel_id"], x["reason"]) for x in rej.collect()) == [
        ("P-1", "already exists"), ("P-7", "duplicate request")]


def test_nsf_corrected_vs_literal(spark):
    roll = _roll(spark, ["P-1"])
    att = spark.createDataFrame([(1, "P-1", M("98.00"), D(2025, 3, 5), "11", None),
                                 (2, "P-1", M("5.00"), D(2025, 3, 6), "12", None)],
                                "seq long, parcel_id string, amount decimal(18,2), date date, "
                                "check_number string, installment_num int")
    j = posting.post_payments(att, roll)
    req = spark.createDataFrame([(10, 1, D(2025, 4, 1)), (11, 2, D(2025, 4, 1)),
                                 (12, 99, D(2025, 4, 1))], "seq long, transaction_id long, date date")
    cor, missing = posting.nsf_reversals(j, req)
    assert [r["reversed_transaction_id"] for r in cor.collect()] == [1]
    assert sorted(r["transaction_id"] for r in missing.collect()) == [2, 99]
    lit, _ = posting.nsf_reversals(j, req, "literal")
    assert sorted(r["reversed_transaction_id"] for r in lit.collect()) == [1, 2]
    again, _ = posting.nsf_reversals(j.unionByName(cor), req.filter("seq = 10"))
    assert again.count() == 0


def test_read_roll_defaults_and_failures(spark):
    d = tempfile.mkdtemp(prefix="roll-")
    ok = os.path.join(d, "ok.csv")
    with open(ok, "w") as f:
        f.write("parcel_id,owner_name,property_address,bill_number,assessment_value,"
                "face_tax_amount,discount_amount,penalty_amount,tax_type\n"
                "P-1,Ann,1 Main St,B1,1000.00,450.00,441.00,495.00,Real Estate\n")
    r = read_roll(spark, ok).first()
    assert r["mailing_address"] == "1 Main St" and r["bill_issue_date"] == D(2025, 3, 1)
    assert r["homestead_exclusion"] == M("0.00") and r["is_installment_plan"] is False
    assert r["status"] == "UNPAID" and r["face_tax_amount"] == M("450.00")
    bad = os.path.join(d, "bad.csv")
    with open(bad, "w") as f:
        f.write("parcel_id,owner_name,property_address,bill_number,assessment_value,"
                "face_tax_amount,discount_amount,penalty_amount,tax_type,bill_issue_date\n"
                "P-1,Ann,1 Main St,B1,1000.00,450.00,441.00,495.00,Real Estate,2025-04\n"
                "P-2,Bo,2 Main St,B2,1000.00,abc,441.00,495.00,Real Estate,2025-3-1\n"
                "P-3,Cy,3 Main St,B3,1000.00,450.00,441.00,495.00,Real Estate,2025-3-1\n")
    with pytest.raises(RollLoadError):
        read_roll(spark, bad)
    good, rejected = read_roll(spark, bad, on_bad="split")
    assert [x["parcel_id"] for x in good.collect()] == ["P-3"]
    assert good.first()["bill_issue_date"] == D(2025, 3, 1)
    assert rejected.count() == 2
    lab = os.path.join(d, "labels.csv")
    with open(lab, "w") as f:
        f.write("Name,Address\n,1 Main St\nBo,\n")
    got = [(x["name"], x["address"]) for x in read_labels(spark, lab).collect()]
    assert got == [("Resident", "1 Main St"), ("Bo", "")]


def _random_commands(seed: int, n: int):
    import random
    rnd = random.Random(seed)
    parcels = {f"P-{i}": {"face": M("300.00"), "discount": M("294.00"), "penalty": M("330.00"),
                          "issue": D(2025, 3, 1), "plan": i % 2 == 0} for i in range(6)}
    cmds, seq = [], 0
    amounts = [M("294.00"), M("300.00"), M("330.00"), M("100.00"), M("110.00"), M("1.00")]
    written = []
    for _ in range(n):
        seq += rnd.randint(1, 3)
        kind = rnd.choices(["pay", "exonerate", "nsf", "close_month"], [6, 1, 2, 1])[0]
        month = rnd.choice([3, 4, 5, 6, 7])
        day = D(2025, month, rnd.randint(1, 28))
        if kind == "pay":
            cmds.append({"seq": seq, "command": kind, "parcel_id": f"P-{rnd.randint(0, 6)}",
                         "amount": rnd.choice(amounts), "date": day, "check_number": "CASH",
                         "installment_num": rnd.choice([None, 1, 2, 3])})
            written.append(seq)
        elif kind == "exonerate":
            cmds.append({"seq": seq, "command": kind, "parcel_id": f"P-{rnd.randint(0, 5)}",
                         "amount": M("300.00"), "date": day, "reason": "r"})
            written.append(seq)
        elif kind == "nsf" and written:
            cmds.append({"seq": seq, "command": kind, "tx_id": rnd.choice(written), "date": day})
            written.append(seq)
        elif kind == "close_month":
            cmds.append({"seq": seq, "command": kind, "month": month, "year": 2025})
    return cmds, parcels


@pytest.mark.parametrize("seed,semantics,n", [(1, "corrected", 120), (2, "corrected", 120),
                                              (3, "corrected", 300), (4, "literal", 120),
                                              (5, "literal", 300)])
def test_replay_matches_sequential_model(spark, seed, semantics, n):
    cmds, parcels = _random_commands(seed, n)
    schema = ("seq long, command string, parcel_id string, amount decimal(18,2), date date, "
              "check_number string, installment_num int, tx_id long, month int, year int, "
              "reason string")
    keys = ["seq", "command", "parcel_id", "amount", "date", "check_number", "installment_num",
            "tx_id", "month", "year", "reason"]
    cdf = spark.createDataFrame([tuple(c.get(k) for k in keys) for c in cmds], schema)
    roll = spark.createDataFrame(
        [(p, "o", "a", "a", "b", M("1"), M("0"), M("0"), v["face"], v["discount"], v["penalty"],
          "Real Estate", v["issue"], v["plan"], False, "UNPAID") for p, v in parcels.items()],
        ", ".join(f"{c} {t}" for c, t in zip(PARCEL_COLUMNS, [
            "string", "string", "string", "string", "string", "decimal(18,2)", "decimal(18,2)",
            "decimal(18,2)", "decimal(18,2)", "decimal(18,2)", "decimal(18,2)", "string", "date",
            "boolean", "boolean", "string"])))
    journal, refused = replay.replay(cdf, roll, semantics)
    want, want_refused = sequential_replay(cmds, parcels, semantics)
    got = {r["transaction_id"]: (r["transaction_type"], r["is_closed"]) for r in journal.collect()}
    assert got == {k: (v["type"], v["is_closed"]) for k, v in want.items()}
    assert sorted(r["transaction_id"] for r in refused.collect()) == sorted(want_refused)


def test_change_log_schema_and_distribution_rules(spark):
    from millrate.plans.monthly import distribution_rules
    from millrate.schemas import CHANGE_LOG
    cur = _roll(spark, ["P-1"])
    after = cur.withColumn("status", F.lit("PAID"))
    log = audit.change_log(cur, after, "parcel_id", ["status"], "tax_duplicate",
                           _dt.datetime(2025, 1, 1))
    assert log.columns == [f.name for f in CHANGE_LOG.fields]
    assert [(r["old_value"], r["new_value"]) for r in log.collect()] == [("UNPAID", "PAID")]
    rules_df = distribution_rules(spark)
    totals = {r["tax_type"]: r["s"] for r in
              rules_df.groupBy("tax_type").agg(F.sum("share").alias("s")).collect()}
    assert totals == {"Real Estate": M("1.000000"), "Per Capita": M("1.000000")}
