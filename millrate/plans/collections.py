"""Collection status report (R7), dashboard tables (R8), delinquency lists
(R2, R3), deposit slips (R5) and mailing labels (R6)."""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrate import config
from millrate.functions import rules, text
from millrate.schemas import MONEY, PARCEL_COLUMNS

def _zero() -> F.Column:
    return F.lit(Decimal("0.00")).cast(MONEY)


def _combine_one_row(*parts: DataFrame) -> DataFrame:
    """Merge one-row aggregates without a cross join: align the columns
    (NULL where a part lacks one), union, and keep each column's one
    non-NULL value with ``max``."""
    cols: list[str] = []
    for p in parts:
        cols += [c for c in p.columns if c not in cols]
    types = {f.name: f.dataType for p in parts for f in p.schema.fields}
    aligned = [p.select(*[(F.col(c) if c in p.columns else F.lit(None).cast(types[c])).alias(c)
                          for c in cols]) for p in parts]
    u = aligned[0]
    for a in aligned[1:]:
        u = u.unionByName(a)
    return u.agg(*[F.max(c).alias(c) for c in cols])


def status_kpis(parcels: DataFrame, journal: DataFrame) -> DataFrame:
    """Parcels, face value, money collected and the collection rate.

    ``total_collected`` counts PAYMENT rows only, as the reference does;
    ``net_collected`` also nets NSF reversals (bounced money).
    """
    t = F.col("transaction_type")
    roll = parcels.agg(F.count(F.lit(1)).alias("total_parcels"),
                       F.coalesce(F.sum("face_tax_amount"), _zero()).cast(MONEY)
                       .alias("total_face_value"))
    money = journal.agg(
        F.coalesce(F.sum(F.when(t == "PAYMENT", F.col("amount_paid"))), _zero()).cast(MONEY)
        .alias("total_collected"),
        F.coalesce(F.sum(F.when(t.isin("PAYMENT", "NSF_REVERSAL"), F.col("amount_paid"))),
                   _zero()).cast(MONEY).alias("net_collected"))
    k = _combine_one_row(roll, money)
    return k.select(
        "total_parcels", "total_face_value", "total_collected", "net_collected",
        rules.collection_rate("total_collected", "total_face_value").alias("collection_rate"),
        rules.collection_rate("net_collected", "total_face_value").alias("net_collection_rate"))


def status_breakdown(parcels: DataFrame) -> DataFrame:
    """Parcel count per status, most frequent first."""
    return parcels.groupBy("status").agg(F.count(F.lit(1)).alias("parcel_count")) \
        .orderBy(F.desc("parcel_count"), "status")


def status_by_tax_type(parcels: DataFrame, journal: DataFrame) -> DataFrame:
    """Per tax type: money of PAYMENT rows and the number of parcels paying."""
    return paid_by_tax_type(paid_by_parcel(parcels, journal))


def paid_by_parcel(parcels: DataFrame, journal: DataFrame) -> DataFrame:
    """PAYMENT rows with their parcel's tax type."""
    pay = journal.filter(F.col("transaction_type") == "PAYMENT").select("parcel_id", "amount_paid")
    return pay.join(parcels.select("parcel_id", "tax_type"), "parcel_id", "inner")


def paid_by_tax_type(paid: DataFrame) -> DataFrame:
    """Money and number of parcels of the rows of :func:`paid_by_parcel`."""
    return paid.groupBy("tax_type").agg(
        F.sum("amount_paid").cast(MONEY).alias("collected"),
        F.count_distinct("parcel_id").alias("parcels_paid"))


def status_report_lines(kpis: DataFrame, breakdown: DataFrame, by_type: DataFrame,
                        as_of: _dt.datetime) -> DataFrame:
    """Markdown lines of the status report, one per row, ordered by section and
    rank.  All fixed lines come from one ``kpis`` row."""
    fixed = [
        (1, [F.lit("# Tax Collection Status Report"),
             F.lit(f"**Date:** {as_of:%Y-%m-%d %H:%M}\n"),
             F.lit("## 1. High-Level Summary"),
             F.concat(F.lit("*   **Total Parcels:** "), F.col("total_parcels").cast("string")),
             F.concat(F.lit("*   **Total Face Value:** "), text.money_text("total_face_value")),
             F.concat(F.lit("*   **Total Collected (YTD):** "), text.money_text("total_collected")),
             F.concat(F.lit("*   **Collection Rate:** "), text.pct_text("collection_rate")),
             F.lit("## 2. Parcel Status Breakdown")]),
        (3, [F.lit(""), F.lit("## 3. Revenue by Tax Type"),
             F.lit("| Tax Type | Parcels Paid | Amount Collected |"), F.lit("| :--- | :---: | :---: |")])]
    lines = kpis.select(F.inline(F.array(*[
        F.struct(F.lit(section).alias("section"), F.lit(rank).alias("rank"), line.alias("line"))
        for section, each in fixed for rank, line in enumerate(each)])))
    status_lines = breakdown.select(
        F.lit(2).alias("section"),
        F.row_number().over(Window.orderBy(F.desc("parcel_count"), "status")).alias("rank"),
        F.concat(F.lit("*   **"), F.col("status"), F.lit(":** "),
                 F.col("parcel_count").cast("string"), F.lit(" parcels")).alias("line"))
    type_lines = by_type.select(
        F.lit(4).alias("section"), F.row_number().over(Window.orderBy("tax_type")).alias("rank"),
        F.concat(F.lit("| "), F.col("tax_type"), F.lit(" | "),
                 F.col("parcels_paid").cast("string"), F.lit(" | "),
                 text.money_text("collected"), F.lit(" |")).alias("line"))
    no_types = by_type.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
        F.lit(4).alias("section"), F.lit(1).alias("rank"), F.lit(config.NO_PAYMENTS_LINE).alias("line"))
    return lines.unionByName(status_lines).unionByName(type_lines).unionByName(no_types) \
        .orderBy("section", "rank")


def dashboard_kpis(parcels: DataFrame, journal: DataFrame) -> DataFrame:
    """Face value, collected, rate, paid parcels of all, outstanding estimate."""
    t = F.col("transaction_type")
    roll = parcels.agg(
        F.coalesce(F.sum("face_tax_amount"), _zero()).cast(MONEY).alias("total_face_value"),
        F.count(F.lit(1)).alias("total_parcels"),
        F.count_if(F.col("status") == "PAID").alias("paid_parcels"))
    money = journal.agg(F.coalesce(F.sum(F.when(t == "PAYMENT", F.col("amount_paid"))), _zero())
                        .cast(MONEY).alias("total_collected"))
    k = _combine_one_row(roll, money)
    return k.select(
        "total_face_value", "total_collected",
        rules.collection_rate("total_collected", "total_face_value").alias("collection_rate"),
        "total_parcels", "paid_parcels",
        (F.col("total_face_value") - F.col("total_collected")).cast(MONEY)
        .alias("outstanding_balance"))


def dashboard_revenue(parcels: DataFrame, journal: DataFrame) -> DataFrame:
    """Money of every journal row by its parcel's tax type (left join; NULL type dropped)."""
    j = journal.select("parcel_id", "amount_paid").join(
        parcels.select("parcel_id", "tax_type"), "parcel_id", "left")
    return j.filter(F.col("tax_type").isNotNull()).groupBy("tax_type").agg(
        F.sum("amount_paid").cast(MONEY).alias("amount_paid"))


def recent_activity(journal: DataFrame, limit: int | None = None) -> DataFrame:
    """Six display columns, newest first (ties: larger transaction id first)."""
    out = journal.select(
        F.to_date("date_received").alias("date_received"), "parcel_id", "transaction_type",
        "amount_paid", "payment_method", "check_number", "transaction_id"
    ).orderBy(F.desc("date_received"), F.desc("transaction_id"))
    return out.limit(limit) if limit else out


def return_list(parcels: DataFrame) -> DataFrame:
    """Every column of UNPAID and PARTIAL parcels (for the claim bureau)."""
    return parcels.filter(F.col("status").isin("UNPAID", "PARTIAL")).select(*PARCEL_COLUMNS)


def turnover_report(parcels: DataFrame, tax_year: int) -> DataFrame:
    """Lien list: seven columns; total = face + penalty as the reference prints it.

    ``penalty_only_due`` is the amount actually owed after the face deadline.
    """
    d = parcels.filter(F.col("status").isin("UNPAID", "PARTIAL"))
    return d.select(
        "parcel_id", "owner_name", "property_address",
        F.lit(tax_year).alias("tax_year"),
        F.col("face_tax_amount").alias("face_tax"),
        F.col("penalty_amount").alias("penalty"),
        rules.turnover_total_due().alias("total_amount_due"),
        F.col("penalty_amount").alias("penalty_only_due"))


TURNOVER_TITLES = {
    "parcel_id": "Parcel ID", "owner_name": "Owner Name", "property_address": "Property Address",
    "tax_year": "Tax Year", "face_tax": "Face Tax", "penalty": "Penalty",
    "total_amount_due": "Total Amount Due",
}


def deposit_slip(journal: DataFrame, include_rejected: bool = False) -> DataFrame:
    """Checks received per day (the deposit list); rejected checks optional."""
    j = journal.filter(F.col("payment_method") == "CHECK")
    if not include_rejected:
        j = j.filter(F.col("transaction_type") != "REJECTED_PAYMENT")
    return j.select("date_received", "check_number", "amount_paid", "parcel_id",
                    "transaction_id")


def deposit_totals(journal: DataFrame, include_rejected: bool = False) -> DataFrame:
    """Count and sum of checks for every day at once."""
    return deposit_slip(journal, include_rejected).groupBy("date_received").agg(
        F.count(F.lit(1)).alias("check_count"),
        F.sum("amount_paid").cast(MONEY).alias("total_amount"))


def deposit_slip_text(journal: DataFrame, include_rejected: bool = False) -> DataFrame:
    """The lines of every day's slip: date_received, section, line_id, value.

    Section 1 is the head (``DEPOSIT SLIP - <day>``, count, total, a rule),
    section 2 the columns' titles, section 3 a line per check in the order of
    its id.  Columns are right-aligned to the day's widest value.  A day's
    checks stay rows, so a busy day is no single text.
    """
    checks = deposit_slip(journal, include_rejected).select(
        "date_received", "transaction_id", F.coalesce("check_number", F.lit("None")).alias("check_number"),
        "amount_paid", "parcel_id")
    cents = F.col("amount_paid") * 100 % 10 != 0
    days = checks.groupBy("date_received").agg(
        F.count(F.lit(1)).alias("check_count"), F.sum("amount_paid").cast(MONEY).alias("total_amount"),
        F.max(F.length("check_number")).alias("w_check"), F.max(F.length("parcel_id")).alias("w_parcel"),
        F.max(F.length(F.col("amount_paid").cast("string"))).alias("w_amount"),
        F.max(cents).alias("cents"))
    # Amounts show two decimals if any check of the day needs them, else one.
    days = days.withColumns({
        "w_check": F.greatest("w_check", F.lit(len("check_number"))),
        "w_parcel": F.greatest("w_parcel", F.lit(len("parcel_id"))),
        "w_amount": F.greatest(F.col("w_amount") - F.when(F.col("cents"), 0).otherwise(1),
                               F.lit(len("amount_paid")))})

    def line(check: F.Column, amount: F.Column, parcel: F.Column) -> F.Column:
        return F.concat_ws(" ", F.lpad(check, F.col("w_check"), F.lit(" ")),
                           F.concat(F.lit(" "), F.lpad(amount, F.col("w_amount"), F.lit(" "))),
                           F.lpad(parcel, F.col("w_parcel"), F.lit(" ")))

    head = F.array(
        F.concat(F.lit("DEPOSIT SLIP - "), F.date_format("date_received", "yyyy-MM-dd")),
        F.concat(F.lit("Total Count: "), F.col("check_count").cast("string")),
        F.concat(F.lit("Total Amount: "), text.money_text("total_amount")), F.lit("-" * 30),
        line(F.lit("check_number"), F.lit("amount_paid"), F.lit("parcel_id")))
    heads = days.select("date_received", F.posexplode(head).alias("at", "value")).select(
        "date_received", F.when(F.col("at") < 4, 1).otherwise(2).alias("section"),
        F.col("at").cast("long").alias("line_id"), "value")
    paid = F.col("amount_paid").cast("string")
    shown = F.when(F.col("cents"), paid).otherwise(F.regexp_replace(paid, "0$", ""))
    lines = checks.join(days.select("date_received", "w_check", "w_amount", "w_parcel", "cents"), "date_received").select(
        "date_received", F.lit(3).alias("section"), F.col("transaction_id").alias("line_id"),
        line(F.col("check_number"), shown, F.col("parcel_id")).alias("value"))
    return heads.unionByName(lines)


def mailing_labels(parcels: DataFrame) -> DataFrame:
    """Name and mailing address of every parcel."""
    return parcels.select(F.col("owner_name").alias("name"),
                          F.col("mailing_address").alias("address"), "parcel_id")
