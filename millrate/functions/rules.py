"""Billing rules as Column expressions (no UDFs; all inside codegen).

Every function takes and returns ``pyspark.sql.Column`` so the rules compose
into one projection next to the join that brings the parcel to the attempt.
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrate import config
from millrate.schemas import MONEY

ColumnLike = Column | str


def _c(col: ColumnLike) -> Column:
    return F.col(col) if isinstance(col, str) else col


def effective_issue_date(issue: ColumnLike, default: _dt.date | None = None) -> Column:
    """Empty or NULL issue date falls back to the configured default."""
    return F.coalesce(_c(issue), F.lit(default or config.DEFAULT_ISSUE_DATE))


# D1 ------------------------------------------------------------------------
def discount_end(issue: ColumnLike) -> Column:
    """Last discount day: issue + 2 months - 1 day (month-end clamped)."""
    return F.date_sub(F.add_months(_c(issue), 2), 1)


def face_end(issue: ColumnLike) -> Column:
    """Last face day: issue + 4 months - 1 day (month-end clamped)."""
    return F.date_sub(F.add_months(_c(issue), 4), 1)


def penalty_start(issue: ColumnLike) -> Column:
    return F.date_add(face_end(issue), 1)


def printed_face_deadline(issue: ColumnLike, semantics: str = "corrected") -> Column:
    """Face deadline as printed on a bill.  ``literal`` prints issue + 2 months."""
    if semantics == "literal":
        return F.add_months(_c(issue), 2)
    return face_end(issue)


def printed_penalty_start(issue: ColumnLike) -> Column:
    """Penalty start as printed on a bill: issue + 4 months."""
    return F.add_months(_c(issue), 4)


# D2 ------------------------------------------------------------------------
def payment_period(postmark: ColumnLike, issue: ColumnLike,
                   default_issue: _dt.date | None = None) -> Column:
    """DISCOUNT up to discount_end, FACE up to face_end, else PENALTY (NULL without a date)."""
    iss = effective_issue_date(issue, default_issue)
    pm = _c(postmark)
    return (F.when(pm <= discount_end(iss), F.lit("DISCOUNT"))
            .when(pm <= face_end(iss), F.lit("FACE"))
            .when(pm.isNotNull(), F.lit("PENALTY")))


# D3 ------------------------------------------------------------------------
def expected_amount(period: ColumnLike, discount: ColumnLike = "discount_amount",
                    face: ColumnLike = "face_tax_amount",
                    penalty: ColumnLike = "penalty_amount") -> Column:
    """The amount in force in a period (NULL without one)."""
    p = _c(period)
    return (F.when(p == "DISCOUNT", _c(discount))
            .when(p == "FACE", _c(face))
            .when(p == "PENALTY", _c(penalty)))


# D6 ------------------------------------------------------------------------
def installment_amount(face: ColumnLike = "face_tax_amount") -> Column:
    """One of three equal installments of the face amount, HALF_UP to cents."""
    return F.round(_c(face) / F.lit(3), 2).cast(MONEY)


def installment_penalty_amount(face: ColumnLike = "face_tax_amount") -> Column:
    """An installment with the 10 % late charge, HALF_UP to cents."""
    return F.round(installment_amount(face) * F.lit(Decimal("1.10")), 2).cast(MONEY)


# D4 ------------------------------------------------------------------------
def validation_code(amount: ColumnLike, period: ColumnLike, expected: ColumnLike,
                    face: ColumnLike, is_installment_plan: ColumnLike,
                    installment_num: ColumnLike) -> Column:
    """Ordered validation of one attempt against its parcel (no other rows)."""
    amt, per, exp = _c(amount), _c(period), _c(expected)
    plan = F.coalesce(_c(is_installment_plan), F.lit(False))
    num = _c(installment_num)
    return (
        F.when(amt == exp, F.lit("ACCEPTED_FULL"))
        .when(plan & (per == "PENALTY") & (num.isNull() | (num == 1)),
              F.lit("REJECTED_INSTALLMENT_LATE"))
        .when(plan & (amt == installment_amount(face)), F.lit("ACCEPTED_INSTALLMENT"))
        .when(plan & (amt == installment_penalty_amount(face)),
              F.lit("ACCEPTED_INSTALLMENT_PENALTY"))
        .when(amt > exp, F.lit("REJECTED_OVER"))
        .otherwise(F.lit("REJECTED_UNDER"))
    )


def is_accepted(code: ColumnLike) -> Column:
    return _c(code).startswith("ACCEPTED")


# D7 ------------------------------------------------------------------------
def payment_method(check_number: ColumnLike) -> Column:
    return F.when(_c(check_number) == "CASH", F.lit("CASH")).otherwise(F.lit("CHECK"))


# D10 -----------------------------------------------------------------------
def status_event(transaction_type: ColumnLike, balance_remaining: ColumnLike,
                 semantics: str = "corrected") -> Column:
    """Status a single journal row would set, NULL when it sets none.

    ``literal``: a payment posted by the pay command carries no type at the
    moment the status branch runs, so payments set nothing.
    """
    t = _c(transaction_type)
    ev = F.when(t == "RETURN", F.lit("RETURNED")).when(
        t == "EXONERATION", F.lit("EXONERATED")).when(t == "NSF_REVERSAL", F.lit("UNPAID"))
    if semantics == "literal":
        return ev
    return (F.when(t == "PAYMENT",
                   F.when(F.coalesce(_c(balance_remaining), F.lit(Decimal("0.00")))
                          <= F.lit(config.PAID_BALANCE_EPSILON), F.lit("PAID"))
                   .otherwise(F.lit("PARTIAL")))
            .otherwise(ev))


# D11 -----------------------------------------------------------------------
def period_on(as_of: _dt.date, issue: ColumnLike) -> Column:
    """Period name in force on ``as_of`` for a bill issued on ``issue``."""
    day = F.lit(as_of)
    iss = _c(issue)
    return (F.when(day <= discount_end(iss), F.lit("DISCOUNT"))
            .when(day <= face_end(iss), F.lit("FACE")).otherwise(F.lit("PENALTY")))


def amount_due_on(as_of: _dt.date, status: ColumnLike, issue: ColumnLike = "bill_issue_date",
                  discount: ColumnLike = "discount_amount", face: ColumnLike = "face_tax_amount",
                  penalty: ColumnLike = "penalty_amount") -> Column:
    """Amount due today for open statuses; NULL for PAID/EXONERATED/RETURNED."""
    closed = _c(status).isin("PAID", "EXONERATED", "RETURNED")
    return F.when(~closed, expected_amount(period_on(as_of, issue), discount, face, penalty))


# D13 -----------------------------------------------------------------------
def month_start(d: ColumnLike) -> Column:
    return F.trunc(_c(d), "MM")


def month_bounds(month: int, year: int) -> tuple[_dt.date, _dt.date]:
    """Half-open [first day, first day of next month) with December rollover."""
    start = _dt.date(year, month, 1)
    end = _dt.date(year + 1, 1, 1) if month == 12 else _dt.date(year, month + 1, 1)
    return start, end


# D14 -----------------------------------------------------------------------
def collection_rate(collected: ColumnLike, face: ColumnLike) -> Column:
    """collected / face x 100; 0 when the face total is not positive."""
    f = _c(face).cast("double")
    return F.when(f > 0, _c(collected).cast("double") / f * F.lit(100.0)).otherwise(F.lit(0.0))


# D15 -----------------------------------------------------------------------
def turnover_total_due(face: ColumnLike = "face_tax_amount",
                       penalty: ColumnLike = "penalty_amount") -> Column:
    """Face + penalty, as the lien list prints it (penalty already holds face)."""
    return (_c(face) + _c(penalty)).cast(MONEY)


# D19 -----------------------------------------------------------------------
def history_note(check_number: ColumnLike, notes: ColumnLike) -> Column:
    """Prefix ``Ck#<n> `` when a real check number is present."""
    ck, nt = _c(check_number), F.coalesce(_c(notes), F.lit(""))
    has_check = ck.isNotNull() & (ck != "") & (ck != "CASH")
    return F.when(has_check, F.concat(F.lit("Ck#"), ck, F.lit(" "), nt)).otherwise(nt)


# D20 -----------------------------------------------------------------------
def label_slot(label_index: ColumnLike) -> dict[str, Column]:
    """Page, row, column and text origin (inches) of a 0-based label index."""
    n = _c(label_index)
    per_page = config.LABELS_ACROSS * config.LABELS_DOWN
    within = F.pmod(n, F.lit(per_page))
    row = F.floor(within / F.lit(config.LABELS_ACROSS)).cast("int")
    col = F.pmod(within, F.lit(config.LABELS_ACROSS)).cast("int")
    x = (F.lit(config.LABEL_LEFT_MARGIN_IN)
         + col * F.lit(config.LABEL_WIDTH_IN + config.LABEL_COL_GUTTER_IN) + F.lit(config.LABEL_TEXT_X_IN))
    y = (F.lit(config.PAGE_HEIGHT_IN - config.LABEL_TOP_OFFSET_IN - config.LABEL_TEXT_DROP_IN)
         - row * F.lit(config.LABEL_HEIGHT_IN) + F.lit(config.LABEL_TEXT_Y_IN))
    return {
        "page": (F.floor(n / F.lit(per_page)) + 1).cast("int"),
        "label_row": row,
        "label_col": col,
        "x_in": F.round(x, 4),
        "y_in": F.round(y, 4),
    }
