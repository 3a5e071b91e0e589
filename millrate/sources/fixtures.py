"""Stand-in inputs built from the driver's TPC-H-like tables.

These builders shape rows into the schemas the ledger jobs expect (roll,
payment attempts, command requests), computing only what FIXTURES.md
prescribes for that: e.g. an attempt's amount is derived from its bill's
amounts and dates, and exonerations target parcels without a payment.
They do not validate, post or derive status; the jobs in
``millrate.operators`` and ``millrate.plans`` do that work, with their own
code, on whatever rows they are given.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrate.schemas import MONEY

EXONERATION_REASON = "Exonerated by order of the board"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def roll_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One billable parcel per order, owner from its customer."""
    o = _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    key = F.col("o_orderkey")
    face = F.col("o_totalprice").cast(MONEY)
    main_st = F.concat(key.cast("string"), F.lit(" Main St"))
    return j.select(
        F.concat(F.lit("P-"), key.cast("string")).alias("parcel_id"),
        F.col("c_name").alias("owner_name"),
        main_st.alias("property_address"),
        F.when(key % 7 == 0, F.concat(F.col("c_custkey").cast("string"), F.lit(" Rental Ave")))
        .otherwise(main_st).alias("mailing_address"),
        F.concat(F.lit("B"), key.cast("string")).alias("bill_number"),
        (face * F.lit(100)).cast(MONEY).alias("assessment_value"),
        F.lit(Decimal("0.00")).cast(MONEY).alias("homestead_exclusion"),
        F.lit(Decimal("0.00")).cast(MONEY).alias("farmstead_exclusion"),
        face.alias("face_tax_amount"),
        F.round(face * F.lit(Decimal("0.98")), 2).cast(MONEY).alias("discount_amount"),
        F.round(face * F.lit(Decimal("1.10")), 2).cast(MONEY).alias("penalty_amount"),
        F.when(key % 10 == 0, F.lit("Per Capita")).when(key % 10 == 1, F.lit("Fire"))
        .otherwise(F.lit("Real Estate")).alias("tax_type"),
        F.col("o_orderdate").cast("date").alias("bill_issue_date"),
        (F.col("o_orderstatus") == "P").alias("is_installment_plan"),
        (key % 50 == 0).alias("is_interim"),
        F.lit("UNPAID").alias("status"),
    )


def attempts_from_lineitem(spark: SparkSession, sf_dir: str, roll: DataFrame,
                           partitions: int | None = None) -> DataFrame:
    """One payment attempt per line item (seq, parcel_id, amount, date, check, inst),
    dealt by ``parcel_id`` over ``partitions`` tasks, if given."""
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    # Line numbers repeat within an order; part and supplier order equal ones.  An
    # attempt shows no other column, so lines equal in these may swap places.  Lines
    # without an order match no bill.  Ids leave room for 499 lines an order beside
    # its commands' ids; more lines fail the build instead of meeting another order's ids.
    li = li.filter(F.col("l_orderkey").isNotNull()).withColumn(
        "parcel_id", F.concat(F.lit("P-"), F.col("l_orderkey").cast("string")))
    if partitions:
        li = li.repartition(partitions, "parcel_id")
    li = li.withColumn("rn", F.row_number().over(
        Window.partitionBy("parcel_id").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long"))
    bills = roll.select(
        F.col("parcel_id"), "face_tax_amount", "discount_amount", "penalty_amount",
        "bill_issue_date")
    j = li.join(bills, "parcel_id", "inner")
    date = F.date_add(F.col("bill_issue_date"), (F.col("l_partkey") % 240).cast("int"))
    # Amount the bill asks for on that date (used only to shape the amounts).
    asked = (F.when(date <= F.date_sub(F.add_months("bill_issue_date", 2), 1),
                    F.col("discount_amount"))
             .when(date <= F.date_sub(F.add_months("bill_issue_date", 4), 1),
                   F.col("face_tax_amount"))
             .otherwise(F.col("penalty_amount")))
    third = F.round(F.col("face_tax_amount") / F.lit(3), 2).cast(MONEY)
    k = (F.col("l_orderkey") + F.col("rn")) % 8
    amount = (F.when(k.isin(0, 1), asked)
              .when(k == 2, asked - F.lit(Decimal("0.01")))
              .when(k == 3, asked + F.lit(Decimal("10")))
              .when(k.isin(4, 5, 7), third)
              .otherwise(F.round(third * F.lit(Decimal("1.10")), 2))).cast(MONEY)
    full = F.raise_error(F.concat(F.lit("over 499 lines in order "), F.col("l_orderkey").cast("string")))
    return j.select(
        (F.col("l_orderkey") * 1000 + F.when(F.col("rn") < 500, F.col("rn")).otherwise(full.cast("long")))
        .alias("seq"),
        "parcel_id",
        amount.alias("amount"),
        date.alias("date"),
        F.when(F.col("rn") % 3 == 0, F.lit("CASH"))
        .otherwise(F.col("l_suppkey").cast("string")).alias("check_number"),
        F.when(k == 4, F.lit(1)).when(k == 5, F.lit(2)).when(k == 6, F.lit(3))
        .cast("int").alias("installment_num"),
    )


def nsf_requests(attempts: DataFrame) -> DataFrame:
    """Reversal requests: every attempt id divisible by 97, ten days later."""
    return attempts.filter(F.col("seq") % 97 == 0).select(
        (F.col("seq") + 500).alias("seq"),
        F.col("seq").alias("transaction_id"),
        F.date_add("date", 10).alias("date"),
    )


def exoneration_requests(roll: DataFrame, posted: DataFrame) -> DataFrame:
    """Exonerate every 101st order's parcel that has no accepted payment."""
    key = F.regexp_extract("parcel_id", r"^P-(\d+)$", 1).try_cast("long")
    paid = posted.filter(F.col("transaction_type") == "PAYMENT").select("parcel_id").distinct()
    cand = roll.filter(key % 101 == 0).join(paid, "parcel_id", "left_anti")
    return cand.select(
        (key * 1000 + 999).alias("seq"),
        "parcel_id",
        F.col("face_tax_amount").alias("amount"),
        F.date_add("bill_issue_date", 180).alias("date"),
        F.lit(EXONERATION_REASON).alias("reason"),
    )


def january_closures(journal: DataFrame) -> DataFrame:
    """Close January of every year that has journal rows."""
    return journal.select(F.year("date_received").alias("year")).distinct().select(
        F.lit(1).alias("month"), "year")


def with_orphans(journal: DataFrame) -> DataFrame:
    """Point every 991st transaction at a parcel id that is not on the roll."""
    return journal.withColumn(
        "parcel_id",
        F.when(F.col("transaction_id") % 991 == 0,
               F.concat(F.lit("X-"), F.col("transaction_id").cast("string")))
        .otherwise(F.col("parcel_id")))


def orphan_attempts(attempts: DataFrame) -> DataFrame:
    return attempts.withColumn(
        "parcel_id",
        F.when(F.col("seq") % 991 == 0, F.concat(F.lit("X-"), F.col("seq").cast("string")))
        .otherwise(F.col("parcel_id")))


def undated(attempts: DataFrame) -> DataFrame:
    """Attempts of which every 89th has lost its date."""
    return attempts.withColumn("date", F.when(F.col("seq") % 89 != 0, F.col("date")))


def check_extraction_texts(attempts: DataFrame) -> DataFrame:
    """Model-output JSON text per check attempt: fenced, memo-less or cut, with
    other date formats, without a date, with huge amounts, or no JSON at all."""
    a = attempts.filter(F.col("check_number") != "CASH")
    memo = F.concat(F.lit("2025 tax "), F.col("parcel_id"))
    body = F.to_json(F.struct(
        F.col("check_number"),
        F.when(F.col("seq") % 19 == 0, F.lit(1e30)).otherwise(F.col("amount").cast("double")).alias("amount"),
        F.when(F.col("seq") % 23 != 0, F.when(F.col("seq") % 17 == 0, F.date_format("date", "MMMM d, yyyy"))
               .otherwise(F.date_format("date", "yyyy-MM-dd"))).alias("postmark_date"),
        F.lit("Payer of record").alias("payer_name"),
        F.lit("On file").alias("payer_address"),
        F.when(F.col("seq") % 11 != 0, memo).alias("memo"),
    ))
    body = F.when(F.col("seq") % 13 == 0,
                  F.substring(body, 1, (F.length(body) / 2).cast("int"))).otherwise(body)
    body = F.when(F.col("seq") % 29 == 0, F.lit("I can't read this check.")).otherwise(body)
    text = F.when(F.col("seq") % 2 == 0,
                  F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return a.select(F.col("seq").alias("extraction_id"), text.alias("raw_text"))
