"""Sinks: CSV reports (K1-K4), text documents (K5-K7) and the ledger (K8).

Writers are distributed: each task writes its own part files; nothing is
gathered on the driver.  Month close rewrites only the affected
``receipt_month`` partitions into a new version folder, never over the
path being read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from millrate.operators.util import range_partitions
from millrate.plans.collections import TURNOVER_TITLES


def write_csv(df: DataFrame, path: str, titles: dict[str, str] | None = None, compression: str = "none") -> None:
    """CSV with a header; optional display titles for the columns.  Quotes inside
    values are doubled, as Python's csv module and spreadsheets read them.
    ``compression``: "gzip" for files that take about an eighth of the disk."""
    out = df
    if titles:
        out = df.select(*[F.col(c).alias(titles.get(c, c)) for c in df.columns])
    out.write.mode("overwrite").option("header", True).option("escape", '"').option(
        "compression", compression).csv(path)


def write_turnover(df: DataFrame, path: str, compression: str = "none") -> None:
    """Lien list with the bureau's column titles (CSV in place of xlsx)."""
    write_csv(df.select(*TURNOVER_TITLES), path, TURNOVER_TITLES, compression)


def write_labels_csv(labels: DataFrame, path: str) -> None:
    """``Name,Address`` header, as mail-merge expects."""
    write_csv(labels.select("name", "address"), path, {"name": "Name", "address": "Address"})


def write_text(df: DataFrame, path: str, text_col: str = "value",
               partition_by: str | None = None) -> None:
    """One line (or multi-line document) per row as plain text."""
    w = df.select(text_col, *([partition_by] if partition_by else [])).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.text(path)


def write_documents(df: DataFrame, path: str) -> None:
    """Receipts/letters as Parquet rows (file name + text) for a renderer."""
    df.write.mode("overwrite").parquet(path)


def write_ledger(journal: DataFrame, path: str, partitions: int | None = None) -> None:
    """Journal partitioned by receipt month; only months present are replaced.

    Range partitioning on (receipt_month, parcel_id) spreads a busy month
    over many tasks (never one task per month).
    """
    staged = journal.withColumn("receipt_month", F.trunc("date_received", "MM"))
    keys = ("receipt_month", "parcel_id")
    staged = staged.repartitionByRange(partitions or range_partitions(journal), *keys)
    (staged
     .sortWithinPartitions("receipt_month", "parcel_id", "transaction_id")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("receipt_month").parquet(path))


def turnover_schema(df: DataFrame) -> StructType:
    """Types of a written lien list, under its titles."""
    return StructType([StructField(t, df.schema[c].dataType) for c, t in TURNOVER_TITLES.items()])


def close_month_partitions(spark: SparkSession, journal_path: str, closures: DataFrame,
                           out_path: str) -> int:
    """Month close on stored data: read only the closed months (partition
    pruning), set ``is_closed`` and write those months to a new version folder
    ``out_path``; the path being read is never overwritten.
    :func:`read_version` reads both as one ledger.

    Returns the number of rows newly closed.
    """
    months = [r["m"] for r in closures.select(
        F.make_date("year", "month", F.lit(1)).alias("m")).distinct().collect()]
    part = spark.read.parquet(journal_path).filter(F.col("receipt_month").isin(months))
    write_ledger(part.withColumn("is_closed", F.lit(True)), out_path)
    return part.filter(~F.col("is_closed")).count()


def read_version(spark: SparkSession, base_path: str, *version_paths: str) -> DataFrame:
    """A ledger with its versions: a month is read from the last folder that has
    it.  Months are folders, so only their names are compared."""
    out = spark.read.parquet(base_path)
    for path in version_paths:
        newer = spark.read.schema(out.schema).parquet(path)
        months = [r["receipt_month"] for r in newer.select("receipt_month").distinct().collect()]
        out = out.filter(~F.col("receipt_month").isin(months)).unionByName(newer)
    return out
