"""Text rules: validation messages, plain-language reasons, memo parsing,
money formatting, mailto links and audit lines — all built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrate.functions.rules import ColumnLike, _c

# --- fixed values: validation messages ---------------------------------------
MSG_FULL = "Exact Match (Full Payment)"
MSG_INSTALLMENT_LATE = ("Installment plan invalid during Penalty Period. "
                        "Full penalty amount required.")
MSG_INSTALLMENT = "Exact Match (Installment {n})"
MSG_INSTALLMENT_PENALTY = "Exact Match (Penalty Installment {n})"
MSG_OVER = "OVERPAYMENT of ${diff}. Do not deposit. Issue Refund/Return Check."
MSG_UNDER = "UNDERPAYMENT of ${diff}. Exact amount required or valid installment."

# --- fixed values: plain-language reasons on rejection letters -----------------
PLAIN_UNDER = (
    "We noticed the check amount was less than the total due. By law, we are required to collect "
    "the exact amount listed on the tax bill and cannot accept partial payments. Because this check "
    "was for a lower amount, we are unable to process it and must return it to you.")
PLAIN_OVER = (
    "We noticed the check amount was higher than the total due. Since we cannot accept extra funds "
    "or issue change from the tax account, we must return this check to you. Please simply write a "
    "new check for the exact amount shown below.")
PLAIN_LATE = (
    "It appears this payment was intended for an installment plan or a previous discount period, but "
    "it arrived after the deadline. As a result, the amount due has changed. We have to return this "
    "check so you can issue a new one for the current amount.")
PLAIN_OTHER = (
    "We are unable to process this payment as submitted. Please review the specific reason below and "
    "issue a new check for the correct amount. If you have any questions, please contact our office.")

UNKNOWN_PARCEL = "UNKNOWN (Please Enter)"
# -----------------------------------------------------------------------------


def float_text(value: ColumnLike) -> Column:
    """Shortest round-trip text of a number, as a float prints (``9.0``)."""
    return _c(value).cast("double").cast("string")


def fixed2_text(value: ColumnLike) -> Column:
    """``%.2f`` text of a number."""
    return F.format_string("%.2f", _c(value).cast("double"))


def money_text(value: ColumnLike) -> Column:
    """``$1,234.50`` — thousands separators, two decimals."""
    return F.concat(F.lit("$"), F.format_number(_c(value).cast("double"), 2))


def pct_text(value: ColumnLike) -> Column:
    return F.concat(F.format_string("%.1f", _c(value).cast("double")), F.lit("%"))


def validation_message(code: ColumnLike, amount: ColumnLike, expected: ColumnLike,
                       installment_num: ColumnLike, semantics: str = "literal") -> Column:
    """Message of a validation code.

    ``literal`` prints the difference as a float does (``$10.0``) and a
    missing installment number as 1 (installment) or ``None`` (penalty
    installment); ``corrected`` prints two decimals.
    """
    cd, amt, exp, num = _c(code), _c(amount), _c(expected), _c(installment_num)
    diff_over = amt - exp
    diff_under = exp - amt
    if semantics == "literal":
        over_txt, under_txt = float_text(diff_over), float_text(diff_under)
        inst_n = F.coalesce(F.nullif(num, F.lit(0)), F.lit(1)).cast("string")
        pen_n = F.coalesce(num.cast("string"), F.lit("None"))
    else:
        over_txt, under_txt = fixed2_text(diff_over), fixed2_text(diff_under)
        inst_n = F.coalesce(num, F.lit(1)).cast("string")
        pen_n = F.coalesce(num, F.lit(1)).cast("string")
    return (
        F.when(cd == "ACCEPTED_FULL", F.lit(MSG_FULL))
        .when(cd == "REJECTED_INSTALLMENT_LATE", F.lit(MSG_INSTALLMENT_LATE))
        .when(cd == "ACCEPTED_INSTALLMENT", F.replace(F.lit(MSG_INSTALLMENT), F.lit("{n}"), inst_n))
        .when(cd == "ACCEPTED_INSTALLMENT_PENALTY",
              F.replace(F.lit(MSG_INSTALLMENT_PENALTY), F.lit("{n}"), pen_n))
        .when(cd == "REJECTED_OVER", F.replace(F.lit(MSG_OVER), F.lit("{diff}"), over_txt))
        .otherwise(F.replace(F.lit(MSG_UNDER), F.lit("{diff}"), under_txt))
    )


def rejection_note(message: ColumnLike, code: ColumnLike, prefix: str = "Rejected: ") -> Column:
    """``Rejected: <message> (<code>)``."""
    return F.concat(F.lit(prefix), _c(message), F.lit(" ("), _c(code), F.lit(")"))


def plain_reason_key(reason: ColumnLike) -> Column:
    """A/B/C/D category of a rejection reason; the order of tests matters."""
    up = F.upper(_c(reason))
    return (F.when(up.contains("UNDERPAYMENT"), F.lit("A"))
            .when(up.contains("OVERPAYMENT"), F.lit("B"))
            .when(up.contains("INSTALLMENT") | up.contains("LATE"), F.lit("C"))
            .otherwise(F.lit("D")))


def plain_reason(reason: ColumnLike) -> Column:
    key = plain_reason_key(reason)
    return (F.when(key == "A", F.lit(PLAIN_UNDER)).when(key == "B", F.lit(PLAIN_OVER))
            .when(key == "C", F.lit(PLAIN_LATE)).otherwise(F.lit(PLAIN_OTHER)))


def parcel_from_memo(memo: ColumnLike) -> Column:
    """First whitespace-separated token starting with ``P-``; else UNKNOWN."""
    m = _c(memo)
    tokens = F.split(F.regexp_replace(m, r"^\s+|\s+$", ""), r"\s+")
    first = F.try_element_at(F.filter(tokens, lambda t: t.startswith("P-")), F.lit(1))
    return F.coalesce(F.when(m.contains("P-"), first), F.lit(UNKNOWN_PARCEL))  # first is computed once


def _python_quote(text: Column) -> Column:
    """URL-quote as Python's ``quote`` does (``%20`` spaces, ``/`` and ``~`` kept)."""
    enc = F.url_encode(text)
    enc = F.replace(enc, F.lit("+"), F.lit("%20"))
    enc = F.replace(enc, F.lit("%2F"), F.lit("/"))
    enc = F.replace(enc, F.lit("%7E"), F.lit("~"))
    return F.replace(enc, F.lit("*"), F.lit("%2A"))


def fill_template(template: str, **fields: Column) -> Column:
    """Substitute ``{name}`` placeholders of a fixed template with columns."""
    out: Column = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("None")))
    return out


def mailto_link(email: str, subject: Column, body: Column) -> Column:
    return F.concat(F.lit(f"mailto:{email}?subject="), _python_quote(subject),
                    F.lit("&body="), _python_quote(body))


def audit_line_fields(timestamp: ColumnLike, field: ColumnLike, old: ColumnLike,
                      new: ColumnLike) -> dict[str, Column]:
    """Timestamp cut to seconds with a space; empty/NULL printed as ``-``."""
    def dash(c: ColumnLike) -> Column:
        v = _c(c)
        return F.when(v.isNull() | (v == ""), F.lit("-")).otherwise(v)

    return {
        "time": F.replace(F.substring(_c(timestamp), 1, 19), F.lit("T"), F.lit(" ")),
        "field": dash(field),
        "old": dash(old),
        "new": dash(new),
    }
