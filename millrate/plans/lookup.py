"""Parcel lookup (R9): schedule, amount due, status text and history."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrate import config
from millrate.functions import rules, text
from millrate.schemas import MONEY


def bill_schedule(parcels: DataFrame) -> DataFrame:
    """Deadlines of every bill (issue date NULL falls back to the default)."""
    iss = rules.effective_issue_date("bill_issue_date")
    return parcels.select(
        "parcel_id", iss.alias("bill_issue_date"),
        rules.discount_end(iss).alias("discount_end"),
        rules.face_end(iss).alias("face_end"),
        rules.penalty_start(iss).alias("penalty_start"))


def installment_schedule(parcels: DataFrame) -> DataFrame:
    """Three equal installments of installment-plan parcels with their due rule."""
    plan = parcels.filter(F.coalesce("is_installment_plan", F.lit(False)))
    iss = rules.effective_issue_date("bill_issue_date")
    inst = plan.select(
        "parcel_id", rules.installment_amount().alias("installment_amount"),
        rules.face_end(iss).alias("face_end"), rules.penalty_start(iss).alias("penalty_start"),
        F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("installment_no"))
    return inst.select(
        "parcel_id", F.col("installment_no").cast("int").alias("installment_no"),
        "installment_amount",
        F.when(F.col("installment_no") < 3, F.lit("By Face Deadline"))
        .otherwise(F.lit("By Penalty Start")).alias("due_rule"),
        F.when(F.col("installment_no") < 3, F.col("face_end"))
        .otherwise(F.col("penalty_start")).alias("due_date"))


def _due_columns(as_of: _dt.date) -> list[F.Column]:
    """period_name, amount_due and status_message of a parcel."""
    st = F.col("status")
    iss = rules.effective_issue_date("bill_issue_date")
    due = rules.amount_due_on(as_of, st, iss)
    period = rules.period_on(as_of, iss)
    msg = (F.when(st == "PAID", F.lit(config.LOOKUP_PAID))
           .when(st == "EXONERATED", F.lit(config.LOOKUP_EXONERATED))
           .when(st == "RETURNED", F.lit(config.LOOKUP_RETURNED))
           .otherwise(F.concat(F.lit("This bill is currently "), st, F.lit(". We are in the "),
                               period, F.lit(" period.\nThe total amount due TODAY is "),
                               text.money_text(due), F.lit("."))))
    return [F.when(~st.isin("PAID", "EXONERATED", "RETURNED"), period).alias("period_name"),
            due.cast(MONEY).alias("amount_due"), msg.alias("status_message")]


def amount_due(parcels: DataFrame, as_of: _dt.date) -> DataFrame:
    """Status, period in force and amount due on ``as_of`` for every parcel."""
    return parcels.select("parcel_id", "status", *_due_columns(as_of))


def find_parcel(parcels: DataFrame, term: str, literal: bool = False) -> DataFrame:
    """First parcel matching an id or a case-insensitive owner-name fragment.

    Exact id wins; then the smallest parcel id.  ``%`` and ``_`` in the term act
    as wildcards, or stand for themselves with ``literal``; a backslash always
    stands for itself.
    """
    owner = F.col("owner_name")
    named = F.contains(F.lower(owner), F.lower(F.lit(term))) if literal else owner.ilike("%" + term.replace("\\", "\\\\") + "%")
    hit = parcels.filter((F.col("parcel_id") == F.lit(term)) | named)
    return hit.orderBy(F.when(F.col("parcel_id") == F.lit(term), 0).otherwise(1),
                       "parcel_id").limit(1)


def lookup(parcels: DataFrame, term: str, as_of: _dt.date) -> DataFrame:
    """The taxpayer panel of the first match: schedule, installments, amount due."""
    iss = rules.effective_issue_date("bill_issue_date")
    return find_parcel(parcels, term).select(
        "*", rules.discount_end(iss).alias("discount_end"), rules.face_end(iss).alias("face_end"),
        rules.penalty_start(iss).alias("penalty_start"),
        F.when(F.coalesce("is_installment_plan", F.lit(False)), rules.installment_amount())
        .alias("installment_amount"), *_due_columns(as_of))


def parcel_history(journal: DataFrame, parcels: DataFrame,
                   parcel_ids: DataFrame | None = None) -> DataFrame:
    """History rows of parcels on the roll, oldest first, with check notes."""
    j = journal
    if parcel_ids is not None:
        j = j.join(parcel_ids.select("parcel_id"), "parcel_id", "left_semi")
    j = j.join(parcels.select("parcel_id"), "parcel_id", "left_semi")
    return j.select(
        "parcel_id", "transaction_id", "date_received", "transaction_type",
        F.coalesce("payment_method", F.lit("-")).alias("payment_method"),
        "amount_paid", rules.history_note("check_number", "notes").alias("note"),
    ).orderBy("parcel_id", "date_received", "transaction_id")
