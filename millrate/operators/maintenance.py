"""Roll maintenance: re-import (upsert), interim bills, owner/address patches.

Ordered "last one wins" rules are aggregates (``max_by`` over the load
order), not per-key windows, so a key repeated a million times is still
combined map-side before the shuffle.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrate.schemas import MONEY, PARCEL_COLUMNS


def _last_per_key(df: DataFrame, key: str, order_col: str, cols: list[str],
                  first: bool = False) -> DataFrame:
    pick = F.min_by if first else F.max_by
    packed = F.struct(*[F.col(c) for c in cols])
    return df.groupBy(key).agg(pick(packed, F.col(order_col)).alias("_r")).select(
        key, *[F.col(f"_r.{c}").alias(c) for c in cols if c != key])


def upsert_parcels(current: DataFrame, incoming: DataFrame, order_col: str = "row_no",
                   semantics: str = "corrected") -> DataFrame:
    """Replace whole parcel rows from a re-import; the last duplicate wins.

    One full outer join gives kept, replaced and new rows.

    ``literal``: a replaced row returns to the column defaults, so status
    becomes UNPAID and ``is_interim`` false (INSERT OR REPLACE behaviour).
    ``corrected``: status and ``is_interim`` of existing parcels are kept.
    """
    data_cols = [c for c in PARCEL_COLUMNS if c not in ("parcel_id", "status", "is_interim")]
    inc = _last_per_key(incoming, "parcel_id", order_col, ["parcel_id", *data_cols])
    new = inc.select("parcel_id", *[F.col(c).alias(f"_new_{c}") for c in data_cols], F.lit(True).alias("_given"))
    j = current.select(*PARCEL_COLUMNS).join(new, "parcel_id", "full_outer")
    given = F.col("_given").isNotNull()

    def kept(c: str, default) -> F.Column:
        """A replaced row's status or flag."""
        return F.lit(default) if semantics == "literal" else F.coalesce(c, F.lit(default))

    own = {c: F.when(given, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in data_cols}
    own["is_interim"] = F.when(given, kept("is_interim", False)).otherwise(F.col("is_interim"))
    own["status"] = F.when(given, kept("status", "UNPAID")).otherwise(F.col("status"))
    return j.select("parcel_id", *[own[c].alias(c) for c in PARCEL_COLUMNS if c != "parcel_id"])


def add_interim(current: DataFrame, new: DataFrame,
                order_col: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(roll with accepted interim bills, rejected requests).

    A request is accepted only if its parcel id is absent (first request of
    a repeated id wins; of requests with one place in the order, the one with the
    smallest values).  Accepted and rejected requests add up to all.  Accepted rows: ``is_interim`` true, UNPAID, bill
    number ``INT-<id>``, mailing = property address, type Real Estate unless
    given, exclusions 0.
    """
    cols = new.columns
    same = new.groupBy(*cols).agg(F.count(F.lit(1)).alias("_times"))  # equal requests, once
    place = F.struct(order_col, *[c for c in cols if c != order_col])
    first = same.groupBy("parcel_id").agg(F.min(place).alias("_first")).select("parcel_id", "_first")
    ranked = same.join(first, "parcel_id").withColumn("_is", place.eqNullSafe(F.col("_first")))
    first = ranked.filter("_is").select(*cols)
    again = F.col("_times") - F.col("_is").cast("int")
    repeats = ranked.filter(again > 0).withColumn(
        "_n", F.explode(F.sequence(F.lit(1), again.cast("int")))).select(*cols).withColumn(
        "reason", F.lit("duplicate request"))
    exists = first.join(current.select("parcel_id"), "parcel_id", "left_semi") \
        .withColumn("reason", F.lit("already exists"))
    ok = first.join(current.select("parcel_id"), "parcel_id", "left_anti")
    tax_type = F.col("tax_type") if "tax_type" in ok.columns else F.lit(None).cast("string")
    rows = ok.select(
        "parcel_id", "owner_name", "property_address",
        F.col("property_address").alias("mailing_address"),
        F.concat(F.lit("INT-"), F.col("parcel_id")).alias("bill_number"),
        F.col("assessment_value").cast(MONEY).alias("assessment_value"),
        F.lit(Decimal("0.00")).cast(MONEY).alias("homestead_exclusion"),
        F.lit(Decimal("0.00")).cast(MONEY).alias("farmstead_exclusion"),
        F.col("face_tax_amount").cast(MONEY).alias("face_tax_amount"),
        F.col("discount_amount").cast(MONEY).alias("discount_amount"),
        F.col("penalty_amount").cast(MONEY).alias("penalty_amount"),
        F.coalesce(tax_type, F.lit("Real Estate")).alias("tax_type"),
        F.col("bill_issue_date").cast("date").alias("bill_issue_date"),
        F.lit(False).alias("is_installment_plan"),
        F.lit(True).alias("is_interim"),
        F.lit("UNPAID").alias("status"),
    )
    rejects = exists.unionByName(repeats.select(*exists.columns))
    return current.select(*PARCEL_COLUMNS).unionByName(rows), rejects


def update_parcels(current: DataFrame, patches: DataFrame,
                   order_col: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(patched roll, rejected patches).

    ``patches``: parcel_id, new_name, new_address (empty = not given).  The
    last given value of each field wins; a patch naming no field, or a
    parcel not on the roll, is rejected.
    """
    def given(c: str) -> F.Column:
        return F.col(c).isNotNull() & (F.col(c) != "")

    empty = patches.filter(~given("new_name") & ~given("new_address")) \
        .withColumn("reason", F.lit("no field to update"))
    valid = patches.filter(given("new_name") | given("new_address"))
    missing = valid.join(current.select("parcel_id"), "parcel_id", "left_anti") \
        .withColumn("reason", F.lit("parcel not found"))
    agg = valid.groupBy("parcel_id").agg(
        F.max_by("new_name", F.when(given("new_name"), F.col(order_col))).alias("_name"),
        F.max_by("new_address", F.when(given("new_address"), F.col(order_col))).alias("_addr"))
    j = current.select(*PARCEL_COLUMNS).join(agg, "parcel_id", "left")
    out = j.withColumn("owner_name", F.coalesce("_name", "owner_name")) \
        .withColumn("mailing_address", F.coalesce("_addr", "mailing_address")) \
        .select(*PARCEL_COLUMNS)
    return out, empty.unionByName(missing)
