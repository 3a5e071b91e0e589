"""County roll CSV (S1) and label CSV (S5) readers.

Columns are taken by each file's own header as strings (files may order their
columns differently, or lack optional ones), then projected to
the fixed roll schema with ``try_cast``; bad rows are counted by one
aggregate and fail the load (all-or-nothing), or are returned aside.
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrate import config
from millrate.schemas import PARCEL_COLUMNS, ROLL_CSV_OPTIONAL, ROLL_CSV_REQUIRED
from millrate.sources.csv_records import field, read_records

_MONEY_COLS = ("assessment_value", "homestead_exclusion", "farmstead_exclusion",
               "face_tax_amount", "discount_amount", "penalty_amount")


class RollLoadError(ValueError):
    pass


def _require(columns: list[str]) -> None:
    missing = [c for c in ROLL_CSV_REQUIRED if c not in columns]
    if missing:
        raise RollLoadError(f"roll CSV lacks required columns: {missing}")


def parse_roll(raw: DataFrame, default_issue: _dt.date | None = None) -> DataFrame:
    """Typed roll rows plus a ``_bad`` flag from a string-typed CSV frame."""
    _require(raw.columns)
    default_issue = default_issue or config.DEFAULT_ISSUE_DATE

    def opt(name: str, default):
        """The default stands where a row's file has no such column."""
        if "_header" in raw.columns:
            return F.when(F.array_contains("_header", name), F.col(name)).otherwise(default)
        return F.col(name) if name in raw.columns else default

    zero = F.lit(str(Decimal("0.00")))
    cols = {
        "parcel_id": F.col("parcel_id"),
        "owner_name": F.col("owner_name"),
        "property_address": F.col("property_address"),
        "mailing_address": opt("mailing_address", F.col("property_address")),
        "bill_number": F.col("bill_number"),
        "assessment_value": F.col("assessment_value"),
        "homestead_exclusion": opt("homestead_exclusion", zero),
        "farmstead_exclusion": opt("farmstead_exclusion", zero),
        "face_tax_amount": F.col("face_tax_amount"),
        "discount_amount": F.col("discount_amount"),
        "penalty_amount": F.col("penalty_amount"),
        "tax_type": F.col("tax_type"),
        "bill_issue_date": opt("bill_issue_date", F.lit(default_issue.isoformat())),
        "is_installment_plan": opt("is_installment_plan", F.lit("0")),
    }
    position = [c for c in ("_file", "_at") if c in raw.columns]
    staged = raw.select(*[v.alias(f"__{k}") for k, v in cols.items()], *position)
    date_txt = F.col("__bill_issue_date")
    date_ok = date_txt.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$")
    inst_txt = F.col("__is_installment_plan")
    out = staged.select(
        *[F.col(f"__{k}").alias(k) for k in ("parcel_id", "owner_name", "property_address",
                                              "mailing_address", "bill_number")],
        *[F.expr(f"try_cast(`__{m}` as decimal(18,2))").alias(m) for m in _MONEY_COLS],
        F.col("__tax_type").alias("tax_type"),
        F.when(date_ok, F.try_to_date(date_txt, "yyyy-M-d")).alias("bill_issue_date"),
        F.when(inst_txt.isin("1", "0"), inst_txt == "1").alias("is_installment_plan"),
        F.lit(False).alias("is_interim"),
        F.lit("UNPAID").alias("status"),
        *[F.col(f"__{m}").alias(f"_raw_{m}") for m in _MONEY_COLS],
        date_txt.alias("_raw_date"), inst_txt.alias("_raw_inst"), *position,
    )
    bad = (F.col("parcel_id").isNull() | F.col("bill_issue_date").isNull()
           | F.col("is_installment_plan").isNull())
    for m in _MONEY_COLS:
        bad = bad | (F.col(f"_raw_{m}").isNotNull() & F.col(m).isNull())
    for m in ("assessment_value", "face_tax_amount", "discount_amount", "penalty_amount"):
        bad = bad | F.col(m).isNull()
    if "_file" in raw.columns:
        # The record's place in its file; files follow their names.
        out = out.withColumn("row_no", F.struct(F.col("_file"), F.col("_at")))
        return out.withColumn("_bad", bad).select(*PARCEL_COLUMNS, "row_no", "_bad")
    return out.withColumn("_bad", bad).select(*PARCEL_COLUMNS, "_bad")


def read_roll(spark: SparkSession, path: str, default_issue: _dt.date | None = None,
              on_bad: str = "fail") -> DataFrame | tuple[DataFrame, DataFrame]:
    """Read a county roll CSV into the roll schema, with ``row_no``, the order of
    rows in the file (and of files by name), which :func:`upsert_parcels` takes.

    ``on_bad="fail"``: any unparsable row aborts the load (one aggregate).
    ``on_bad="split"``: returns (good rows, bad rows).
    """
    records, headers = read_records(spark, path)
    for header in headers:
        _require([c or "" for c in header])
    raw = records.select(*[field(c).alias(c) for c in (*ROLL_CSV_REQUIRED, *ROLL_CSV_OPTIONAL)],
                         F.col("header").alias("_header"), F.col("file").alias("_file"), F.col("at").alias("_at"))
    parsed = parse_roll(raw, default_issue)
    if on_bad == "split":
        return (parsed.filter(~F.col("_bad")).drop("_bad"),
                parsed.filter(F.col("_bad")).drop("_bad"))
    n_bad = parsed.agg(F.count_if(F.col("_bad")).alias("n")).first()["n"]
    if n_bad:
        raise RollLoadError(f"{n_bad} roll rows could not be parsed; nothing loaded")
    return parsed.drop("_bad")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Name/Address label CSV; missing Name is 'Resident', missing Address ''.
    ``file_order``: the order of rows in the file, and of files by name."""
    records, _ = read_records(spark, path)
    return records.select(F.coalesce(field("Name"), F.lit("Resident")).alias("name"),
                          F.coalesce(field("Address"), F.lit("")).alias("address"),
                          F.struct("file", "at").alias("file_order"))
