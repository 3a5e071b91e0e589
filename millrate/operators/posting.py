"""Posting payment attempts, exonerations and reversals to the journal.

Validation reads only the attempt and its parcel (never earlier payments),
so a batch of attempts is one equi-join on ``parcel_id`` followed by one
projection.  The join is left to AQE: at scale both sides are large and it
becomes a sort-merge join whose skewed partitions AQE splits.
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrate.functions import rules, text
from millrate.operators.util import conform
from millrate.schemas import JOURNAL_COLUMNS, MONEY

_PARCEL_PRICING = ("parcel_id", "face_tax_amount", "discount_amount", "penalty_amount",
                   "bill_issue_date", "is_installment_plan")


def validate_attempts(attempts: DataFrame, parcels: DataFrame,
                      default_issue: _dt.date | None = None,
                      message_semantics: str = "literal") -> DataFrame:
    """Attempts joined to their parcel with period, expected amount and verdict.

    Unknown parcels drop out of the inner join; see ``unknown_parcels``.
    """
    bills = parcels.select(*_PARCEL_PRICING)
    j = attempts.join(bills, "parcel_id", "inner")
    period = rules.payment_period("date", "bill_issue_date", default_issue)
    j = j.withColumn("payment_period", period)
    j = j.withColumn("expected_amount", rules.expected_amount("payment_period"))
    j = j.withColumn("validation_code", rules.validation_code(
        "amount", "payment_period", "expected_amount", "face_tax_amount",
        "is_installment_plan", "installment_num"))
    j = j.withColumn("is_valid", rules.is_accepted("validation_code"))
    return j.withColumn("message", text.validation_message(
        "validation_code", "amount", "expected_amount", "installment_num",
        message_semantics))


def unknown_parcels(attempts: DataFrame, parcels: DataFrame) -> DataFrame:
    """Attempts whose parcel is not on the roll (no journal row; an error)."""
    return attempts.join(parcels.select("parcel_id"), "parcel_id", "left_anti")


def undated_attempts(attempts: DataFrame, parcels: DataFrame) -> DataFrame:
    """Attempts on parcels of the roll that have no date to be priced by (no
    journal row; an error).  With them, posted and unknown rows add up to the attempts."""
    return attempts.filter(F.col("date").isNull()).join(
        parcels.select("parcel_id"), "parcel_id", "left_semi")


def post_payments(attempts: DataFrame, parcels: DataFrame,
                  default_issue: _dt.date | None = None,
                  message_semantics: str = "literal",
                  force_method: str | None = None,
                  keep_installment: bool = True,
                  note_prefix: str = "Rejected: ") -> DataFrame:
    """Journal rows for a batch of attempts: accepted PAYMENT or REJECTED_PAYMENT.

    Accepted rows carry the period, method and installment number and the
    default balance of 0.00; rejected rows carry the face amount as balance
    and ``Rejected: <message> (<code>)`` as note.  An attempt without a date has
    no price and no month: see :func:`undated_attempts`.
    """
    v = validate_attempts(attempts.filter(F.col("date").isNotNull()), parcels, default_issue, message_semantics)
    ok = F.col("is_valid")
    method = F.lit(force_method) if force_method else rules.payment_method("check_number")
    inst = F.col("installment_num") if keep_installment else F.lit(None).cast("int")
    rows = v.select(
        F.col("seq").alias("transaction_id"),
        F.col("date").alias("date_received"),
        F.col("date").alias("postmark_date"),
        "parcel_id",
        F.when(ok, F.lit("PAYMENT")).otherwise(F.lit("REJECTED_PAYMENT")).alias("transaction_type"),
        method.alias("payment_method"),
        "check_number",
        F.col("amount").cast(MONEY).alias("amount_paid"),
        F.when(ok, F.lit(Decimal("0.00"))).otherwise(F.col("face_tax_amount"))
        .cast(MONEY).alias("balance_remaining"),
        F.when(ok, F.col("payment_period")).alias("payment_period"),
        F.when(ok, inst).cast("int").alias("installment_number"),
        F.lit(None).cast("long").alias("deposit_batch_id"),
        F.lit(False).alias("is_closed"),
        F.lit(None).cast("string").alias("image_path"),
        F.when(~ok, text.rejection_note("message", "validation_code", note_prefix))
        .alias("notes"),
        "validation_code",
        F.lit(None).cast("long").alias("reversed_transaction_id"),
    )
    return rows


def append_journal(journal: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Insert rows with the journal defaults (type PAYMENT, balance 0.00, open).

    ``rows`` needs ``transaction_id``, ``date_received``, ``parcel_id`` and
    ``amount_paid``; any other journal column may be absent.  A row without a
    date fails the job, as it would fail the insert: it has no month to belong to.
    """
    if "date_received" not in rows.columns:
        raise ValueError("date_received is required for a journal row")
    filled = conform(rows, JOURNAL_COLUMNS)
    filled = filled.withColumn(
        "transaction_type", F.coalesce("transaction_type", F.lit("PAYMENT"))
    ).withColumn(
        "balance_remaining", F.coalesce("balance_remaining", F.lit(Decimal("0.00")).cast(MONEY))
    ).withColumn("is_closed", F.coalesce("is_closed", F.lit(False)))
    undated = F.raise_error(F.concat(
        F.lit("date_received is required for journal row "), F.coalesce(F.col("transaction_id").cast("string"), F.lit("?"))))
    filled = filled.withColumn("date_received", F.coalesce("date_received", undated.cast("date")))
    if journal is None:
        return filled
    return journal.select(*JOURNAL_COLUMNS).unionByName(filled)


def exonerate(requests: DataFrame) -> DataFrame:
    """EXONERATION rows: method NONE, the reason as note; nothing is checked.

    ``requests``: seq, parcel_id, amount, date, reason.
    """
    rows = requests.select(
        F.col("seq").alias("transaction_id"),
        F.col("date").alias("date_received"),
        F.col("date").alias("postmark_date"),
        "parcel_id",
        F.lit("EXONERATION").alias("transaction_type"),
        F.lit("NONE").alias("payment_method"),
        F.col("amount").cast(MONEY).alias("amount_paid"),
        F.col("reason").alias("notes"),
    )
    return append_journal(None, rows)


def nsf_reversals(journal: DataFrame, requests: DataFrame,
                  semantics: str = "corrected") -> tuple[DataFrame, DataFrame]:
    """Reversal rows for bounced checks, and the requests that found no row.

    ``requests``: seq (id of the new row), transaction_id (to reverse), date.
    The new row negates the amount, keeps check, period and installment,
    has method ADJUSTMENT and ``balance_remaining`` = original amount.
    ``corrected`` reverses only PAYMENT rows not reversed already, and of
    several requests for one payment the one with the smallest seq;
    ``literal`` reverses whatever row the id names, each time it is asked.
    The second frame holds the requests that wrote no row.
    """
    orig = journal.select(
        "transaction_id", "parcel_id", "transaction_type", "check_number", "amount_paid",
        "payment_period", "installment_number")
    if semantics == "corrected":
        already = journal.filter(F.col("transaction_type") == "NSF_REVERSAL").select(
            F.col("reversed_transaction_id").alias("transaction_id"))
        orig = orig.filter(F.col("transaction_type") == "PAYMENT").join(
            already, "transaction_id", "left_anti")
    req = requests.select(F.col("seq").alias("new_id"), "transaction_id",
                          F.col("date").alias("rev_date"))
    chosen = req
    if semantics == "corrected":
        first = req.groupBy("transaction_id").agg(F.min("new_id").alias("new_id"))
        chosen = req.join(first, ["transaction_id", "new_id"], "left_semi")
    j = chosen.join(orig, "transaction_id", "inner")
    rows = j.select(
        F.col("new_id").alias("transaction_id"),
        F.col("rev_date").alias("date_received"),
        F.col("rev_date").alias("postmark_date"),
        "parcel_id",
        F.lit("NSF_REVERSAL").alias("transaction_type"),
        F.lit("ADJUSTMENT").alias("payment_method"),
        "check_number",
        (-F.col("amount_paid")).cast(MONEY).alias("amount_paid"),
        F.col("amount_paid").cast(MONEY).alias("balance_remaining"),
        "payment_period",
        "installment_number",
        F.concat(F.lit("NSF Reversal for Trans ID "), F.col("transaction_id").cast("string"))
        .alias("notes"),
        F.col("transaction_id").alias("reversed_transaction_id"),
    )
    missing = req.join(rows.select(F.col("transaction_id").alias("new_id")), "new_id", "left_anti")
    return append_journal(None, rows), missing


def close_month(journal: DataFrame, closures: DataFrame) -> DataFrame:
    """Set ``is_closed`` on every row received in a closed month.

    ``closures``: month, year.  The closed months are one row each, a calendar's
    worth: they are broadcast, and the journal is not shuffled (by month at that).
    """
    months = F.broadcast(closures.select(F.make_date("year", "month", F.lit(1)).alias("_close_month"))
                         .distinct())
    j = journal.join(months, rules.month_start("date_received") == F.col("_close_month"), "left")
    return j.withColumn(
        "is_closed", F.col("is_closed") | F.col("_close_month").isNotNull()
    ).drop("_close_month")


def close_month_counts(journal: DataFrame, closures: DataFrame) -> DataFrame:
    """Rows newly closed per requested month (0 when the month has none)."""
    months = closures.select("year", "month", F.make_date("year", "month", F.lit(1))
                             .alias("close_month")).distinct()
    open_rows = journal.filter(~F.col("is_closed")).groupBy(
        rules.month_start("date_received").alias("close_month")).agg(
        F.count(F.lit(1)).alias("rows_closed"))
    return months.join(open_rows, "close_month", "left").select(
        "year", "month", "close_month",
        F.coalesce("rows_closed", F.lit(0)).cast("long").alias("rows_closed"))


def locked_months(journal: DataFrame) -> DataFrame:
    """Months that hold at least one closed row (one row per month)."""
    return journal.filter(F.col("is_closed")).select(
        rules.month_start("date_received").alias("lock_month")).distinct()


def split_by_month_lock(rows: DataFrame, journal: DataFrame,
                        date_col: str = "date_received",
                        type_col: str = "transaction_type") -> tuple[DataFrame, DataFrame]:
    """(allowed, refused): non-rejected rows dated in a locked month are refused.

    Rejected attempts are always recorded.  A row without a type is a PAYMENT.
    """
    return split_by_lock_table(rows, locked_months(journal), date_col, type_col)


def split_by_lock_table(rows: DataFrame, lock_table: DataFrame,
                        date_col: str = "date_received",
                        type_col: str = "transaction_type") -> tuple[DataFrame, DataFrame]:
    """As ``split_by_month_lock`` with a ready lock table (column ``lock_month``).

    One left join with the lock months (a row per month, broadcast) flags each row.
    """
    locks = F.broadcast(lock_table.select(F.col("lock_month").alias("_lock")).distinct())
    flagged = rows.join(locks, rules.month_start(date_col) == F.col("_lock"), "left").withColumn(
        "_refused", F.col("_lock").isNotNull() & (
            F.coalesce(F.col(type_col), F.lit("PAYMENT")) != "REJECTED_PAYMENT"))
    allowed = flagged.filter(~F.col("_refused")).drop("_lock", "_refused")
    return allowed, flagged.filter("_refused").drop("_lock", "_refused")
