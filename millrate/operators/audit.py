"""Audit trail: column-level change log (M13), system events (M14) and the
audit tail (R15).

The change log is the difference of two snapshots: a full outer join on
the key, the compared fields unpivoted with ``inline`` over an array of
structs, and only the changed ones kept (NULL-safe comparison).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrate.functions import text
from millrate.session import cut_lineage


def _as_text(c: F.Column) -> F.Column:
    """Stringify as the reference does: NULL prints 'None'."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def change_log(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str],
               table_name: str, at: _dt.datetime, batch_id: int = 1) -> DataFrame:
    """One row per changed (record, field) between two snapshots.  Changes of a
    batch between snapshots have no order of their own (``log_seq`` is NULL)."""
    b = before.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields],
                      F.lit(True).alias("_in_b"))
    a = after.select(key, *[F.col(f).alias(f"_a_{f}") for f in fields],
                     F.lit(True).alias("_in_a"))
    j = b.join(a, key, "full_outer")
    action = (F.when(F.col("_in_b").isNull(), F.lit("INSERT"))
              .when(F.col("_in_a").isNull(), F.lit("DELETE")).otherwise(F.lit("UPDATE")))
    diffs = F.array(*[
        F.struct(F.lit(f).alias("field_name"),
                 F.when(F.col("_in_b").isNotNull(), _as_text(F.col(f"_b_{f}"))).alias("old_value"),
                 F.when(F.col("_in_a").isNotNull(), _as_text(F.col(f"_a_{f}"))).alias("new_value"),
                 (~F.col(f"_b_{f}").eqNullSafe(F.col(f"_a_{f}"))
                  | F.col("_in_b").isNull() | F.col("_in_a").isNull()).alias("changed"))
        for f in fields])
    rows = j.select(F.col(key).cast("string").alias("record_id"), action.alias("action_type"),
                    F.inline(diffs))
    return rows.filter("changed").select(
        F.lit(batch_id).cast("long").alias("batch_id"),
        F.lit(None).cast("long").alias("log_seq"),
        F.lit(at.isoformat()).alias("timestamp"),
        F.lit(table_name).alias("table_name"),
        "record_id", "field_name", "old_value", "new_value", "action_type",
        F.lit("CLI").alias("user_context"))


#: Records of a bucket, about: few enough that a changed one brings few others along.
BUCKET_ROWS = 16


def changed_buckets(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str],
                    bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both snapshots without the buckets of ``key`` that hold the same rows.

    One aggregate over both: hashes of the rows before are added, those after taken
    away, so equal rows cancel out and only narrow sums are shuffled.  A changed
    bucket stays unnoticed only if two 64-bit hash sums come out equal by chance.
    Repeated rows count as often as they occur; NULL differs from every value.
    """
    buckets = max(1, before.count() // bucket_rows)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_bucket")
    # xxhash64 passes over NULLs, so their places are hashed beside them.
    values = [F.col(c) for c in (key, *fields)] + [F.isnull(c) for c in (key, *fields)]

    def signed(df: DataFrame, sign: int) -> DataFrame:
        one, other = (h.cast("decimal(20,0)") * sign for h in (F.xxhash64(*values), F.xxhash64(F.lit(1), *values)))
        return df.select(bucket, one.alias("_one"), other.alias("_other"), F.lit(sign).alias("_rows"))

    sums = signed(before, 1).unionByName(signed(after, -1)).groupBy("_bucket").agg(
        *[F.sum(c).alias(c) for c in ("_one", "_other", "_rows")])
    differing = cut_lineage(sums.filter("_one != 0 OR _other != 0 OR _rows != 0").select("_bucket"))

    def part(df: DataFrame) -> DataFrame:
        return df.select(key, *fields, bucket).join(differing, "_bucket", "left_semi").drop("_bucket")

    return part(before), part(after)


def change_log_by_bucket(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str],
                         table_name: str, at: _dt.datetime, batch_id: int = 1) -> DataFrame:
    """:func:`change_log` of large snapshots that differ little: only records of
    buckets that changed enter its join."""
    return change_log(*changed_buckets(before, after, key, fields), key, fields, table_name, at, batch_id)


def journal_insert_log(rows: DataFrame, at: _dt.datetime, batch_id: int = 1) -> DataFrame:
    """The INSERT entry every new journal row leaves (amount_paid 0.00 -> amount)."""
    return rows.select(
        F.lit(batch_id).cast("long").alias("batch_id"),
        F.col("transaction_id").alias("log_seq"),
        F.lit(at.isoformat()).alias("timestamp"),
        F.lit("transactions").alias("table_name"),
        F.col("transaction_id").cast("string").alias("record_id"),
        F.lit("amount_paid").alias("field_name"),
        F.lit("0.00").alias("old_value"),
        text.float_text("amount_paid").alias("new_value"),
        F.lit("INSERT").alias("action_type"),
        F.lit("CLI").alias("user_context"))


def system_events(journal: DataFrame, at: _dt.datetime, close_counts: DataFrame | None = None,
                  patched_ids: DataFrame | None = None,
                  interim_ids: DataFrame | None = None) -> DataFrame:
    """Action/details rows: TRANSACTION, NSF_REVERSAL, CLOSE_MONTH, UPDATE_PARCEL, ADD_INTERIM."""
    ts = F.lit(at.isoformat()).alias("timestamp")
    t = F.col("transaction_type")
    tx = journal.filter(t != "NSF_REVERSAL").select(
        ts, F.lit("TRANSACTION").alias("action"),
        F.concat(F.lit("Added transaction for "), F.col("parcel_id"), F.lit(": "),
                 text.float_text("amount_paid")).alias("details"),
        F.col("transaction_id").cast("string").alias("subject_id"))
    nsf = journal.filter(t == "NSF_REVERSAL").select(
        ts, F.lit("NSF_REVERSAL").alias("action"),
        F.concat(F.lit("Reversed transaction "),
                 F.col("reversed_transaction_id").cast("string")).alias("details"),
        F.col("transaction_id").cast("string").alias("subject_id"))
    out = tx.unionByName(nsf)
    if close_counts is not None:
        out = out.unionByName(close_counts.select(
            ts, F.lit("CLOSE_MONTH").alias("action"),
            F.format_string("Closed %d transactions for %d/%d", "rows_closed", "month", "year")
            .alias("details"),
            F.date_format("close_month", "yyyy-MM").alias("subject_id")))
    if patched_ids is not None:
        out = out.unionByName(patched_ids.select(
            ts, F.lit("UPDATE_PARCEL").alias("action"),
            F.concat(F.lit("Updated info for "), F.col("parcel_id")).alias("details"),
            F.col("parcel_id").alias("subject_id")))
    if interim_ids is not None:
        out = out.unionByName(interim_ids.select(
            ts, F.lit("ADD_INTERIM").alias("action"),
            F.concat(F.lit("Added Interim Parcel "), F.col("parcel_id")).alias("details"),
            F.col("parcel_id").alias("subject_id")))
    return out


def audit_tail(log: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` changes, formatted, newest first: by batch, then by the order
    in which the batch's rows were written (numeric), then by key.

    ``orderBy(...).limit(n)`` plans as a top-k (TakeOrderedAndProject):
    each task keeps ``n`` rows, the driver merges them.
    """
    f = text.audit_line_fields("timestamp", "field_name", "old_value", "new_value")
    return log.orderBy(F.desc("batch_id"), F.desc_nulls_last("log_seq"), F.desc("table_name"), F.desc("record_id"),
                       F.desc("field_name")).limit(n).select(
        "batch_id", f["time"].alias("time"), "table_name", "record_id", "action_type",
        f["field"].alias("field"), f["old"].alias("old"), f["new"].alias("new"))
