"""Standing full payments from one pass over the journal, against a plain model."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from millrate.operators.status import parcel_events
from millrate.schemas import JOURNAL

TYPES = ("PAYMENT", "EXONERATION", "RETURN", "NSF_REVERSAL", "REJECTED_PAYMENT", None)


def _rows(seed):
    rnd, rows = random.Random(seed), []
    for i in range(1, 400):
        parcel = "P-1" if rnd.random() < 0.4 else f"P-{rnd.randrange(2, 40)}"
        kind = rnd.choice(TYPES)
        if kind == "NSF_REVERSAL" and rows and rnd.random() < 0.8:
            target = rnd.choice(rows)  # a payment or not, reversed before or not
            parcel, reversed_id = target["parcel_id"], target["transaction_id"]
        else:
            reversed_id = rnd.choice((None, 10_000 + i)) if kind == "NSF_REVERSAL" else None
        amount = Decimal(rnd.randrange(-500, 50_000)) / 100 if rnd.random() < 0.95 else None
        row = dict.fromkeys(JOURNAL.names)
        row.update(transaction_id=i, date_received=dt.date(2025, 1, 1), parcel_id=parcel, transaction_type=kind,
                   amount_paid=amount, reversed_transaction_id=reversed_id,
                   validation_code=rnd.choice(("ACCEPTED_FULL", "ACCEPTED_INSTALLMENT", None)))
        rows.append(row)
    return rows


def _model(rows):
    out = {}
    for parcel in {r["parcel_id"] for r in rows}:
        mine = [r for r in rows if r["parcel_id"] == parcel]
        undone = {r["reversed_transaction_id"] for r in mine if r["transaction_type"] == "NSF_REVERSAL"}
        flagged = [r for r in mine if r["transaction_type"] in ("PAYMENT", "EXONERATION", "RETURN", "NSF_REVERSAL")]
        out[parcel] = (
            max(flagged, key=lambda r: r["transaction_id"])["transaction_type"] if flagged else None,
            sum((r["amount_paid"] or 0 for r in mine if r["transaction_type"] in ("PAYMENT", "NSF_REVERSAL")), Decimal(0)),
            sum((r["amount_paid"] or 0 for r in mine if r["transaction_type"] == "EXONERATION"), Decimal(0)),
            sum(r["transaction_type"] == "PAYMENT" and r["validation_code"] == "ACCEPTED_FULL"
                and r["transaction_id"] not in undone for r in mine))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_events_equal_the_model(spark, seed):
    rows = _rows(seed)
    frame = spark.createDataFrame([tuple(r[c] for c in JOURNAL.names) for r in rows], JOURNAL)
    got = {r["parcel_id"]: (r["last_event"], r["net_paid"], r["exonerated"], r["live_full"])
           for r in parcel_events(frame).collect()}
    assert got == _model(rows)


def test_one_scan_of_the_journal(spark, ledger):
    from millrate.operators.status import parcel_status
    plan = parcel_status(ledger.roll, ledger.journal)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reversed_transaction_id#") > 0
    assert sum("Relation" in line and "transaction_type" in line for line in plan.splitlines()) == 1


def test_empty_journal(spark):
    assert parcel_events(spark.createDataFrame([], JOURNAL)).count() == 0
