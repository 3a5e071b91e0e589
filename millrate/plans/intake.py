"""Check intake from model extractions (M6, R13) and duplicate payments (A11)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrate.functions import text
from millrate.operators import posting
from millrate.sources.extraction import parse_check_extractions


def ingest_payments(extractions: DataFrame, parcels: DataFrame,
                    as_of: _dt.date | None = None) -> DataFrame:
    """Journal rows for parsed checks whose memo names a parcel on the roll.

    As ``post_payments`` but the method is always CHECK, no installment
    number is kept and rejected notes start ``Rejected (Ingest): ``.
    """
    parsed = parse_check_extractions(extractions, as_of=as_of).filter(
        F.col("parse_ok") & (F.col("found_parcel_id") != text.UNKNOWN_PARCEL)
        & F.col("postmark_date").isNotNull())
    attempts = parsed.select(
        F.col("extraction_id").alias("seq"), F.col("found_parcel_id").alias("parcel_id"),
        "amount", F.col("postmark_date").alias("date"), "check_number",
        F.lit(None).cast("int").alias("installment_num"))
    return posting.post_payments(attempts, parcels, force_method="CHECK",
                                 keep_installment=False, note_prefix="Rejected (Ingest): ")


def review_queue(extractions: DataFrame, parcels: DataFrame,
                 as_of: _dt.date | None = None) -> DataFrame:
    """Extractions a person must confirm: unparsable, no parcel, unknown parcel, or
    no date to price by."""
    parsed = parse_check_extractions(extractions, as_of=as_of)
    cols = parsed.columns
    # Rows that cannot name a parcel would all share one join key (NULL or
    # UNKNOWN) and land in a single task; they get a row-specific key that
    # matches no parcel instead, so one pass still covers every row.
    named = F.col("parse_ok") & (F.col("found_parcel_id") != text.UNKNOWN_PARCEL)
    keyed = parsed.withColumn("_k", F.when(named, F.col("found_parcel_id")).otherwise(
        F.concat(F.lit("\u0001"), F.xxhash64(*[F.col(c) for c in cols]).cast("string"))))
    known = parcels.select(F.col("parcel_id").alias("_k"), F.lit(True).alias("_on"))
    j = keyed.join(known, "_k", "left")
    reason = (F.when(~F.col("parse_ok"), F.lit("UNPARSABLE"))
              .when(F.col("found_parcel_id") == text.UNKNOWN_PARCEL, F.lit("NO_PARCEL_IN_MEMO"))
              .when(F.col("_on").isNull(), F.lit("PARCEL_NOT_ON_ROLL"))
              .when(F.col("postmark_date").isNull(), F.lit("NO_POSTMARK_DATE")))
    return j.withColumn("review_reason", reason).filter(F.col("review_reason").isNotNull()) \
        .select(*cols, "review_reason")


def duplicate_payments(journal: DataFrame) -> DataFrame:
    """(parcel, check, amount, installment) groups of accepted payments recorded more
    than once.  Cash has no check number to repeat; payments without any number can."""
    checks = journal.filter((F.col("transaction_type") == "PAYMENT") & ~F.col("check_number").eqNullSafe("CASH"))
    return checks.groupBy("parcel_id", "check_number", "amount_paid", "installment_number").agg(
        F.count(F.lit(1)).alias("times_recorded"),
        F.min("transaction_id").alias("first_transaction_id")).filter(
        F.col("times_recorded") > 1)
