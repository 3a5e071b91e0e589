"""Document data: bills (R10), receipts (R11), rejection letters (R12) and
the label sheet (R14).  Page drawing is out of scope; each output row holds
the fields a renderer needs, built with column expressions."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrate import config
from millrate.functions import rules, text
from millrate.operators.util import global_row_number

BILL_TYPES = ("Township_County", "School")


def bill_run(parcels: DataFrame, bill_type: str = "Township_County",
             run_date: _dt.date | None = None, semantics: str = "corrected",
             org: dict | None = None, contact: dict | None = None) -> DataFrame:
    """One billing row per parcel (the same amounts for both bill types).

    ``literal`` prints the face deadline as issue + 2 months, as the
    reference's bill does; ``corrected`` prints the last face day.
    """
    org = {**config.ORGANIZATION, **(org or {})}
    contact = {**config.CONTACT, **(contact or {})}
    run_date = run_date or config.DEFAULT_ISSUE_DATE
    iss = rules.effective_issue_date("bill_issue_date")
    subject = text.fill_template(contact["subject_template"], parcel_id=F.col("parcel_id"))
    body = text.fill_template(contact["body_template"], parcel_id=F.col("parcel_id"),
                              collector_name=F.lit(org["collector_name"]),
                              owner_name=F.col("owner_name"))
    suffix = f"{run_date:%Y-%m}"
    return parcels.select(
        F.lit(bill_type).alias("bill_type"),
        "parcel_id", "owner_name", "mailing_address", "property_address", "bill_number",
        F.concat(F.lit("$"), text.fixed2_text("assessment_value")).alias("assessed_value_text"),
        F.concat(F.lit("$"), text.fixed2_text("discount_amount")).alias("discount_text"),
        F.concat(F.lit("$"), text.fixed2_text("face_tax_amount")).alias("face_text"),
        F.concat(F.lit("$"), text.fixed2_text("penalty_amount")).alias("penalty_text"),
        F.date_format(rules.discount_end(iss), "MMM dd").alias("discount_by"),
        F.date_format(rules.printed_face_deadline(iss, semantics), "MMM dd").alias("face_by"),
        F.date_format(rules.printed_penalty_start(iss), "MMM dd").alias("penalty_from"),
        F.when(F.coalesce("is_installment_plan", F.lit(False)),
               F.concat(F.lit("$"), text.fixed2_text(rules.installment_amount())))
        .alias("installment_text"),
        text.mailto_link(contact["email"], subject, body).alias("mailto_link"),
        F.concat(F.lit(f"{bill_type}_"), F.col("parcel_id"), F.lit(f"_Bill_{suffix}.pdf"))
        .alias("file_name"),
    )


def receipts(journal: DataFrame, parcels: DataFrame, printed_at: _dt.datetime,
             org: dict | None = None, accepted_only: bool = True) -> DataFrame:
    """One text receipt per transaction (by default accepted payments only).

    The status line shows the parcel's status instead of a fixed
    "PAID IN FULL", which the reference printed for any transaction.
    """
    org = {**config.ORGANIZATION, **(org or {})}
    j = journal
    if accepted_only:
        j = j.filter(F.col("transaction_type") == "PAYMENT")
    j = j.select("transaction_id", "parcel_id", "amount_paid", "payment_period",
                 "check_number", "date_received") \
        .join(parcels.select("parcel_id", "owner_name", "property_address", "status"),
              "parcel_id", "inner")
    line = "=" * 40
    body = F.concat_ws(
        "\n", F.lit(line), F.lit(f"OFFICIAL TAX RECEIPT - {org['township_name']}"), F.lit(line),
        F.lit(f"Date: {printed_at:%Y-%m-%d %H:%M:%S}"),
        F.concat(F.lit("Receipt #: "), F.col("transaction_id").cast("string")), F.lit(""),
        F.concat(F.lit("Parcel ID:      "), F.col("parcel_id")),
        F.concat(F.lit("Owner:          "), F.coalesce("owner_name", F.lit("None"))),
        F.concat(F.lit("Property:       "), F.coalesce("property_address", F.lit("None"))),
        F.lit(""),
        F.concat(F.lit("Amount Paid:    $"), text.fixed2_text("amount_paid")),
        F.concat(F.lit("Payment Period: "), F.coalesce("payment_period", F.lit("None"))),
        F.concat(F.lit("Check Number:   "), F.coalesce("check_number", F.lit("None"))),
        F.lit(""),
        F.concat(F.lit("Status: "), F.col("status")),
        F.lit(line), F.lit(f"Tax Collector: {org['collector_name']}"))
    return j.select(
        "transaction_id", "parcel_id", "date_received", "amount_paid",
        F.concat(F.lit("Receipt_"), F.col("parcel_id"), F.lit("_"),
                 F.col("transaction_id").cast("string"), F.lit(".txt")).alias("file_name"),
        body.alias("receipt_text"))


def rejection_letters(journal: DataFrame, parcels: DataFrame,
                      note_prefixes: tuple[str, ...] = ("Rejected: ", "Rejected (Ingest): ")
                      ) -> DataFrame:
    """One letter row per rejected attempt: addressee, amount, reasons, amounts due."""
    rej = journal.filter(F.col("transaction_type") == "REJECTED_PAYMENT").select(
        "transaction_id", "parcel_id", "amount_paid", "check_number", "notes", "date_received")
    reason = F.col("notes")
    for prefix in note_prefixes:
        reason = F.when(reason.startswith(prefix),
                        F.substr(reason, F.lit(len(prefix) + 1))).otherwise(reason)
    j = rej.join(parcels.select("parcel_id", "owner_name", "mailing_address", "discount_amount",
                                "face_tax_amount", "penalty_amount"), "parcel_id", "inner")
    return j.select(
        "transaction_id", "parcel_id", "owner_name", "mailing_address", "date_received",
        F.col("amount_paid").alias("attempted_amount"), "check_number",
        reason.alias("rejection_reason"),
        text.plain_reason_key(reason).alias("plain_reason_key"),
        text.plain_reason(reason).alias("plain_reason"),
        "discount_amount", "face_tax_amount", "penalty_amount")


def label_sheet(labels: DataFrame, order_col: str = "parcel_id",
                partitions: int | None = None) -> DataFrame:
    """Page, row and column of every label, numbered in ``order_col`` order.

    Numbering uses per-partition offsets over a range partitioning, not a
    window over one partition.
    """
    lab = labels.select(
        order_col,
        F.coalesce(F.col("name"), F.lit("Resident")).alias("name"),
        F.coalesce(F.col("address"), F.lit("")).alias("address"))
    numbered = global_row_number(lab, [order_col], "label_no", partitions)
    slot = rules.label_slot(F.col("label_no") - 1)
    return numbered.select("label_no", order_col, "name", "address",
                           *[v.alias(k) for k, v in slot.items()])
