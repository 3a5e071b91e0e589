"""Row-by-row Python models used as brute-force oracles on small fixtures."""

from __future__ import annotations

import datetime as _dt
from decimal import ROUND_HALF_UP, Decimal

CENT = Decimal("0.01")


def _add_months(d: _dt.date, n: int) -> _dt.date:
    y, m = divmod(d.month - 1 + n, 12)
    y, m = d.year + y, m + 1
    last = [31, 29 if (y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)) else 28, 31, 30, 31, 30,
            31, 31, 30, 31, 30, 31][m - 1]
    return _dt.date(y, m, min(d.day, last))


def period(postmark: _dt.date, issue: _dt.date | None) -> str:
    issue = issue or _dt.date(2025, 3, 1)
    if postmark <= _add_months(issue, 2) - _dt.timedelta(days=1):
        return "DISCOUNT"
    if postmark <= _add_months(issue, 4) - _dt.timedelta(days=1):
        return "FACE"
    return "PENALTY"


def validate_one(p: dict, amount: Decimal, postmark: _dt.date, inst: int | None) -> str:
    per = period(postmark, p.get("issue"))
    expected = {"DISCOUNT": p["discount"], "FACE": p["face"], "PENALTY": p["penalty"]}[per]
    if amount == expected:
        return "ACCEPTED_FULL"
    if p.get("plan"):
        if per == "PENALTY" and (inst is None or inst == 1):
            return "REJECTED_INSTALLMENT_LATE"
        third = (p["face"] / 3).quantize(CENT, ROUND_HALF_UP)
        if amount == third:
            return "ACCEPTED_INSTALLMENT"
        if amount == (third * Decimal("1.10")).quantize(CENT, ROUND_HALF_UP):
            return "ACCEPTED_INSTALLMENT_PENALTY"
    return "REJECTED_OVER" if amount > expected else "REJECTED_UNDER"


def sequential_replay(commands: list[dict], parcels: dict[str, dict],
                      semantics: str = "corrected") -> tuple[dict[int, dict], list[int]]:
    """Apply commands one at a time in ``seq`` order; (journal by id, refused seqs)."""
    journal: dict[int, dict] = {}
    refused: list[int] = []
    reversed_ids: set[int] = set()

    def locked(d: _dt.date) -> bool:
        return any(r["is_closed"] and (r["date"].year, r["date"].month) == (d.year, d.month)
                   for r in journal.values())

    for c in sorted(commands, key=lambda c: c["seq"]):
        kind = c["command"]
        if kind == "pay":
            p = parcels.get(c["parcel_id"])
            if p is None:
                continue
            code = validate_one(p, c["amount"], c["date"], c.get("installment_num"))
            ok = code.startswith("ACCEPTED")
            if ok and locked(c["date"]):
                refused.append(c["seq"])
                continue
            journal[c["seq"]] = {"type": "PAYMENT" if ok else "REJECTED_PAYMENT",
                                 "date": c["date"], "is_closed": False}
        elif kind == "exonerate":
            if locked(c["date"]):
                refused.append(c["seq"])
                continue
            journal[c["seq"]] = {"type": "EXONERATION", "date": c["date"], "is_closed": False}
        elif kind == "nsf":
            orig = journal.get(c["tx_id"])
            if orig is None:
                continue
            if semantics == "corrected" and (orig["type"] != "PAYMENT"
                                             or c["tx_id"] in reversed_ids):
                continue
            reversed_ids.add(c["tx_id"])
            journal[c["seq"]] = {"type": "NSF_REVERSAL", "date": c["date"], "is_closed": False}
        elif kind == "close_month":
            for r in journal.values():
                if (r["date"].year, r["date"].month) == (c["year"], c["month"]):
                    r["is_closed"] = True
    return journal, refused
