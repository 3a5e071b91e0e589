"""Roll and journal stored in buckets of ``parcel_id`` (J1-J6).

Every report joins the two on ``parcel_id``.  As bucketed tables of one bucket
count, the journal also in folders by month, their joins and the per-parcel
aggregates read matching buckets and shuffle neither side.

A bucket is one task, so parcels with more rows than an average bucket holds (there
are fewer of them than buckets) are kept out of the buckets, in a plain table of
month folders beside them.  :meth:`CoLocated.each` runs a per-parcel job on both
parts; the hot one is shuffled, or its few parcels broadcast, as usual.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrate.functions import rules
from millrate.operators.util import read_bytes

#: Bytes of stored input for each bucket.  A bucket is a task, which sorts its rows in
#: memory; but months are folders, so smaller buckets would make small files.
BUCKET_BYTES = 128 * 1024 * 1024


@dataclass
class CoLocated:
    """Bucketed roll and journal, and the hot parcels beside them (None: none)."""

    roll: DataFrame
    journal: DataFrame
    hot_parcels: DataFrame | None = None
    hot_journal: DataFrame | None = None

    def each(self, job: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """``job(roll, journal)`` over the buckets and over the hot parcels.  The
        job works parcel by parcel: no row of its result needs both parts."""
        if self.hot_parcels is None:
            return job(self.roll, self.journal)
        hot = F.broadcast(self.hot_parcels)  # fewer rows than buckets
        cold_roll = self.roll.join(hot, "parcel_id", "left_anti")
        hot_roll = F.broadcast(self.roll.join(hot, "parcel_id", "left_semi"))
        return job(cold_roll, self.journal).unionByName(job(hot_roll, self.hot_journal))


def bucket_count(spark: SparkSession, *tables: DataFrame) -> int:
    """Buckets for the tables: one per core, or per :data:`BUCKET_BYTES`, if more."""
    stored = sum(read_bytes(t) for t in tables)
    return max(spark.sparkContext.defaultParallelism, math.ceil(stored / BUCKET_BYTES))


def save_buckets(df: DataFrame, name: str, path: str, buckets: int, months: bool) -> None:
    """Store ``df``, already dealt by ``parcel_id`` over ``buckets`` tasks, as a
    bucketed table: the same hash deals rows to buckets, so a file a bucket (and month)."""
    writer = df.write.format("parquet").mode("overwrite").option("path", path).option("compression", "zstd")
    if months:
        writer = writer.partitionBy("receipt_month")
    writer.bucketBy(buckets, "parcel_id").sortBy("parcel_id").saveAsTable(name)


def table_name(path: str) -> str:
    """The catalog's name of the bucketed table with its files under ``path``."""
    return f"millrate_{hashlib.sha1(path.encode()).hexdigest()[:20]}"


def open_buckets(spark: SparkSession, path: str, buckets: int, months: bool) -> DataFrame:
    """A table of :func:`save_buckets`, also one that another application stored."""
    name = table_name(path)
    if not spark.catalog.tableExists(name):
        stored = spark.read.parquet(path).schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {'PARTITIONED BY (receipt_month)' if months else ''} "
                  f"CLUSTERED BY (parcel_id) SORTED BY (parcel_id) INTO {buckets} BUCKETS LOCATION '{path}'")
        if months:  # a new catalog entry knows no folder yet
            spark.catalog.recoverPartitions(name)
    return spark.table(name)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def kept_buckets(spark: SparkSession) -> AbstractContextManager[None]:
    """Within it every scan of a bucketed table keeps the buckets, also one that is
    only written to a table of the same buckets."""
    return _setting(spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")


def dropped_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Within it a job's shuffle files go when it ends, not when the driver happens to
    collect its garbage."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def write_colocated(spark: SparkSession, parcels: DataFrame, journal: DataFrame, name: str, path: str,
                    buckets: int | None = None, dealt: bool = False) -> CoLocated:
    """Store both tables as ``<name>_roll`` and ``<name>_journal`` of the catalog,
    with their files under ``path``, and open them.  ``dealt``: both are bucketed
    tables of ``buckets`` buckets already, whose rows are not shuffled again."""
    n = buckets or bucket_count(spark, parcels, journal)
    with kept_buckets(spark):
        return _write_colocated(spark, parcels, journal, name, path, n, dealt)


def _write_colocated(spark: SparkSession, parcels: DataFrame, journal: DataFrame, name: str, path: str,
                     n: int, dealt: bool) -> CoLocated:
    def save(df: DataFrame, part: str, months: bool) -> None:
        save_buckets(df if dealt else df.repartition(n, "parcel_id"), f"{name}_{part}", f"{path}/{part}", n, months)

    dated = journal.withColumn("receipt_month", rules.month_start("date_received"))
    total = dated.count()
    dated.groupBy("parcel_id").agg(F.count(F.lit(1)).alias("rows")).filter(
        F.col("rows") * n > total).select("parcel_id").write.mode("overwrite").parquet(f"{path}/hot_parcels")
    hot = spark.read.schema("parcel_id string").parquet(f"{path}/hot_parcels")
    save(parcels, "roll", months=False)
    if hot.isEmpty():
        save(dated, "journal", months=True)
    else:
        # NULL ids are a group like any other here.
        keys = F.broadcast(hot.withColumnRenamed("parcel_id", "_hot"))
        is_hot = F.col("parcel_id").eqNullSafe(F.col("_hot"))
        save(dated.join(keys, is_hot, "left_anti"), "journal", months=True)
        dated.join(keys, is_hot, "left_semi").hint("rebalance", "receipt_month").write.mode(
            "overwrite").partitionBy("receipt_month").parquet(f"{path}/hot_journal")
    return open_colocated(spark, name, path)


def open_colocated(spark: SparkSession, name: str, path: str) -> CoLocated:
    """The tables that :func:`write_colocated` stored."""
    roll, journal = spark.table(f"{name}_roll"), spark.table(f"{name}_journal")
    hot = spark.read.schema("parcel_id string").parquet(f"{path}/hot_parcels")
    if hot.isEmpty():
        return CoLocated(roll, journal)
    return CoLocated(roll, journal, hot, spark.read.schema(journal.schema).parquet(f"{path}/hot_journal"))
