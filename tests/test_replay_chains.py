"""Replays whose months open and close one another, against the sequential model."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from brute_force import sequential_replay
from millrate.operators import replay
from millrate.schemas import PARCELS

AMOUNT = Decimal("100.00")
FIELDS = "seq long, command string, parcel_id string, amount decimal(18,2), date date, check_number string, " \
         "installment_num int, tx_id long, reason string, month int, year int"
NAMES = [f.split()[0] for f in FIELDS.replace("(18,2)", "").split(", ")]


def _month(i):
    return dt.date(1930 + i // 12, i % 12 + 1, 5)


def _pay(seq, i):
    return {"seq": seq, "command": "pay", "parcel_id": "P-1", "amount": AMOUNT, "date": _month(i)}


def _nsf(seq, tx_id, i):
    return {"seq": seq, "command": "nsf", "tx_id": tx_id, "date": _month(i)}


def _close(seq, i):
    return {"seq": seq, "command": "close_month", "month": _month(i).month, "year": _month(i).year}


def _run(spark, commands, semantics="corrected"):
    one = dict.fromkeys(PARCELS.names)
    one.update(parcel_id="P-1", face_tax_amount=AMOUNT, discount_amount=AMOUNT, penalty_amount=AMOUNT,
               is_installment_plan=False, bill_issue_date=dt.date(1930, 1, 1))
    roll = spark.createDataFrame([tuple(one.values())], PARCELS)
    frame = spark.createDataFrame([tuple(c.get(n) for n in NAMES) for c in commands], FIELDS)
    kept, refused = replay.replay(frame, roll, semantics)
    parcels = {"P-1": {"discount": AMOUNT, "face": AMOUNT, "penalty": AMOUNT, "issue": dt.date(1930, 1, 1)}}
    want, gone = sequential_replay(commands, parcels, semantics)
    rows = {r["transaction_id"]: r for r in kept.collect()}
    assert {k: (r["transaction_type"], r["is_closed"]) for k, r in rows.items()} == \
        {k: (r["type"], r["is_closed"]) for k, r in want.items()}
    assert sorted(r[0] for r in refused.select("transaction_id").collect()) == sorted(gone)
    return rows


def test_a_chain_of_1000_months_in_twelve_rounds(spark, monkeypatch):
    """The reversal of a month's payment lies in the next month and locks it there,
    or doesn't exist because its payment was refused."""
    commands = [_pay(1, 0)]
    for i in range(1000):
        commands += [_nsf(10 * i + 2, 10 * i + 1, i + 1), _close(10 * i + 3, i + 1), _pay(10 * i + 11, i + 1)]
    rounds, simplify = [], replay._simplify
    monkeypatch.setattr(replay, "_simplify", lambda rows: rounds.append(1) or simplify(rows))
    rows = _run(spark, commands)
    assert len(rounds) <= 12
    assert sum(r["transaction_type"] == "NSF_REVERSAL" for r in rows.values()) == 500


@pytest.mark.parametrize("semantics", ["corrected", "literal"])
@pytest.mark.parametrize("seed", range(4))
def test_random_dependencies(spark, seed, semantics):
    """Few months, many reversals and closes: conditions on several closes."""
    rnd, commands = random.Random(seed), []
    for seq in range(1, 121):
        kind = rnd.choice(("pay", "nsf", "nsf", "close"))
        if kind == "pay" or seq < 4:
            commands.append(_pay(seq, rnd.randrange(8)))
        elif kind == "nsf":
            commands.append(_nsf(seq, rnd.choice(commands)["seq"] if rnd.random() < 0.95 else seq + 1, rnd.randrange(8)))
        else:
            commands.append(_close(seq, rnd.randrange(8)))
    _run(spark, commands, semantics)


def test_reversals_of_reversals(spark):
    commands = [_pay(1, 0)] + [_nsf(k, k - 1, k % 3) for k in range(2, 40)]
    rows = _run(spark, commands, "literal")
    assert [rows[k]["amount_paid"] for k in (2, 3, 4, 39)] == [-AMOUNT, AMOUNT, -AMOUNT, AMOUNT]
    assert rows[3]["balance_remaining"] == -AMOUNT and rows[3]["reversed_transaction_id"] == 2


def test_no_closes(spark):
    assert set(_run(spark, [_pay(1, 0), _nsf(2, 1, 0)])) == {1, 2}
