"""Monthly report: detail, summary, remittance advice and adjustments (R1).

Without a month the report covers every month at once, grouped by
``receipt_month``; with one, the filter on ``receipt_month`` prunes the
journal's month directories and the date range keeps the half-open bound.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrate import config
from millrate.functions import rules
from millrate.schemas import MONEY, SHARE

CORRECTED_TYPES = ("PAYMENT", "NSF_REVERSAL")
T_REMIT = "decimal(18,4)"


def monthly_detail(journal: DataFrame, parcels: DataFrame, month: int | None = None,
                   year: int | None = None) -> DataFrame:
    """Every journal row of the month(s) with its parcel's tax type (inner join)."""
    j = journal
    if "receipt_month" not in j.columns:
        j = j.withColumn("receipt_month", rules.month_start("date_received"))
    if month is not None and year is not None:
        start, end = rules.month_bounds(month, year)
        j = j.filter((F.col("receipt_month") == F.lit(start))
                     & (F.col("date_received") >= F.lit(start))
                     & (F.col("date_received") < F.lit(end)))
    return j.join(parcels.select("parcel_id", "tax_type"), "parcel_id", "inner")


def _typed(detail: DataFrame, types: Sequence[str] | None) -> DataFrame:
    return detail if types is None else detail.filter(F.col("transaction_type").isin(*types))


def monthly_summary(detail: DataFrame, types: Sequence[str] | None = CORRECTED_TYPES) -> DataFrame:
    """Sum by (month, tax type, period); rows with a NULL key are dropped."""
    d = _typed(detail, types).filter(
        F.col("tax_type").isNotNull() & F.col("payment_period").isNotNull())
    return d.groupBy("receipt_month", "tax_type", "payment_period").agg(
        F.sum("amount_paid").cast(MONEY).alias("amount"))


def monthly_summary_rollup(detail: DataFrame,
                           types: Sequence[str] | None = CORRECTED_TYPES) -> DataFrame:
    """Summary plus per-type and per-month subtotal lines (grouping sets)."""
    d = _typed(detail, types).filter(
        F.col("tax_type").isNotNull() & F.col("payment_period").isNotNull())
    m, t, p = F.col("receipt_month"), F.col("tax_type"), F.col("payment_period")
    return d.groupingSets([[m, t, p], [m, t], [m]], m, t, p).agg(
        F.sum("amount_paid").cast(MONEY).alias("amount"))


def rule_rows(shares: dict | None = None, accounts: dict | None = None) -> list[tuple]:
    """The configured rules: tax type, recipient, share, bank, account."""
    accounts = accounts or config.BANK_ACCOUNTS
    return [(t, r, s, *accounts.get(r, (None, None))) for t, r, s in config.distribution_rows(shares)]


def distribution_rules(spark: SparkSession, shares: dict | None = None,
                       accounts: dict | None = None) -> DataFrame:
    """(tax_type, recipient, share, bank_name, account_number) — a few rows."""
    schema = f"tax_type string, recipient string, share {SHARE.simpleString()}, " \
             "bank_name string, account_number string"
    return spark.createDataFrame(rule_rows(shares, accounts), schema)


def remittance_advice(detail: DataFrame, shares: dict | None = None,
                      accounts: dict | None = None,
                      types: Sequence[str] | None = CORRECTED_TYPES) -> DataFrame:
    """Per month: what each recipient is owed, what stays unallocated, the total.

    One pass: totals by (month, tax type) are exploded into one row per
    recipient of that tax type — from a literal map of the configured
    shares, a few fixed rows — plus an ``UNALLOCATED`` row for tax types
    without rules and a ``TOTAL COLLECTED`` row, then summed per recipient.
    """
    by_type: dict[str, list] = {}
    for tax_type, *rule in rule_rows(shares, accounts):
        by_type.setdefault(tax_type, []).append(rule)

    def slot(recipient: str, share: Decimal, bank, acct) -> F.Column:
        return F.struct(F.lit(recipient).alias("recipient"),
                        F.lit(share).cast(SHARE).alias("share"),
                        F.lit(bank).cast("string").alias("bank_name"),
                        F.lit(acct).cast("string").alias("account_number"))

    unalloc = F.array(slot("UNALLOCATED", Decimal("1"), None, None))
    per_type = unalloc
    t = F.col("tax_type")
    for tax_type, rows in reversed(list(by_type.items())):
        per_type = F.when(t == tax_type, F.array(*[slot(*r) for r in rows])).otherwise(per_type)
    split = F.concat(per_type, F.array(slot("TOTAL COLLECTED", Decimal("1"), None, None)))
    totals = _typed(detail, types).groupBy("receipt_month", "tax_type").agg(
        F.sum("amount_paid").cast(MONEY).alias("total"))
    exploded = totals.select("receipt_month", "total", F.inline(split))
    return exploded.groupBy("receipt_month", "recipient", "bank_name", "account_number").agg(
        F.sum(F.col("total") * F.col("share")).cast(T_REMIT).alias("amount"))


def monthly_adjustments(detail: DataFrame) -> DataFrame:
    """Exonerations and returns of each month (DCED lines 6 and 7)."""
    t = F.col("transaction_type")
    zero = F.lit(Decimal("0.00")).cast(MONEY)
    return detail.groupBy("receipt_month").agg(
        F.coalesce(F.sum(F.when(t == "EXONERATION", F.col("amount_paid"))), zero)
        .cast(MONEY).alias("exonerations"),
        F.coalesce(F.sum(F.when(t == "RETURN", F.col("amount_paid"))), zero)
        .cast(MONEY).alias("returns"))


#: Base-2 logarithm of a sketch's buckets: a standard error of 0.4%, 64 KB at most.
SKETCH_LG_K = 16


def payer_sketches(detail: DataFrame) -> DataFrame:
    """A sketch of the parcels that paid for each month and tax type: a table to
    keep, of which any months are counted together without the journal."""
    return detail.filter(F.col("transaction_type") == "PAYMENT").groupBy("receipt_month", "tax_type").agg(
        F.hll_sketch_agg("parcel_id", SKETCH_LG_K).alias("payers"))


def payers_of(sketches: DataFrame, *keys: str) -> DataFrame:
    """About how many parcels paid, by ``keys`` of the sketches (none: over all).  A
    parcel that paid in several months counts once."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("payers")).alias("payers"))
