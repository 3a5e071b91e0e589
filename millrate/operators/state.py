"""Status state kept by batches of journal rows instead of recomputed (M12, A13).

The state holds the first aggregate of :func:`status.parcel_events`: a row per
month, parcel and payment (all rows of a parcel that name no payment share one),
with the latest event, sums and counts.  These add up over batches, so a batch is
aggregated by itself and appended; a reversal meets its payment when the state is
read, whichever batch either came in.

A reopened month is given anew as a whole: the batch names the month in
``replaces`` and holds all its rows, and what earlier batches wrote for the month
no longer counts.  Work for a batch therefore follows its own rows; the state's
earlier folders are not read.

Layout under ``path``: ``batch=<id>/receipt_month=<month>/``, and a manifest
``_published/<id>`` with the replaced months, put in place last.  A batch without
a manifest doesn't exist, a retry overwrites its own folder, and a batch that has
been published is not applied again.

With ``buckets`` given to its first batch, a state's folders hold a file a bucket
of ``parcel_id``: batches of rows that are dealt alike are added, compacted and
read without a shuffle, and no task holds more than a bucket.
"""

from __future__ import annotations

import datetime as _dt
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrate.functions import rules
from millrate.operators.status import event_groups, events_of_groups, merge_groups
from millrate.session import hadoop_path, remove_path
from millrate.sources.bucketed import kept_buckets, table_name

GROUPS = ("parcel_id string, _target long, _last long, _net decimal(28,2), _exonerated decimal(28,2), "
          "_full long, _reversals long, batch long, receipt_month date")
_EVERY_MONTH = "all"


def _published(spark: SparkSession, path: str) -> dict[int, list[str] | str]:
    """The published batches with the months each replaces: one file a batch since
    the last compaction was cleaned up."""
    folder, fs = hadoop_path(spark, f"{path}/_published")
    if not fs.exists(folder):
        return {}
    found = {}
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.isdigit():
            stream = fs.open(status.getPath())
            found[int(name)] = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
    return found


def _put(spark: SparkSession, path: str, name: str, value: list[str] | str | int) -> None:
    staged, fs = hadoop_path(spark, f"{path}/_published/.{name}")
    target, _fs = hadoop_path(spark, f"{path}/_published/{name}")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps(value), "utf-8"))
    out.close()
    if not fs.rename(staged, target):
        raise OSError(f"batch {name} of {path} was not published")


def _publish(spark: SparkSession, path: str, batch_id: int, replaces: list[str] | str) -> None:
    _put(spark, path, str(batch_id), replaces)


def _buckets(spark: SparkSession, path: str) -> int | None:
    """The number of buckets that the state was begun with (None: it has none)."""
    marker, fs = hadoop_path(spark, f"{path}/_published/buckets")
    if not fs.exists(marker):
        return None
    stream = fs.open(marker)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _table(spark: SparkSession, path: str, buckets: int) -> str:
    """The catalog's name of a state with buckets, also one of another application."""
    name = table_name(path)
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} ({GROUPS}) USING parquet PARTITIONED BY (batch, receipt_month) "
                  f"CLUSTERED BY (parcel_id) INTO {buckets} BUCKETS LOCATION '{path}'")
        spark.catalog.recoverPartitions(name)
    return name


def _write(groups: DataFrame, path: str, batch_id: int) -> None:
    spark = groups.sparkSession
    buckets = _buckets(spark, path)
    if buckets:
        remove_path(spark, f"{path}/batch={batch_id}")  # of a try that was not published
        columns = spark.table(_table(spark, path, buckets)).columns
        groups.withColumn("batch", F.lit(batch_id).cast("long")).select(*columns).write.mode(
            "append").insertInto(table_name(path))
        return
    # Rebalanced by month: a month's rows share files, a large month is split.
    groups.hint("rebalance", "receipt_month").write.mode("overwrite").partitionBy(
        "receipt_month").parquet(f"{path}/batch={batch_id}")


def _is_new(spark: SparkSession, path: str, batch_id: int) -> bool:
    known = _published(spark, path)
    if batch_id in known:
        return False
    if known and batch_id < max(known):
        raise ValueError(f"batch {batch_id} comes after batch {max(known)} in the state {path}")
    return True


def apply_batch(spark: SparkSession, path: str, rows: DataFrame, batch_id: int,
                replaces: Iterable[_dt.date] = (), buckets: int | None = None) -> bool:
    """Add a batch of journal rows; False if it was applied before.

    ``batch_id`` rises from batch to batch.  Months in ``replaces`` (their first
    days) are taken from this batch alone, which holds all their rows; a month
    named without rows becomes empty.  ``buckets`` counts for a state's first batch;
    rows of a table with as many buckets of ``parcel_id`` are not shuffled.
    """
    if not _is_new(spark, path, batch_id):
        return False
    if buckets and not _published(spark, path) and _buckets(spark, path) is None:
        _put(spark, path, "buckets", buckets)
    dated = rows.withColumn("receipt_month", rules.month_start("date_received"))
    with kept_buckets(spark):
        _write(event_groups(dated, "receipt_month"), path, batch_id)
    _publish(spark, path, batch_id, sorted({m.replace(day=1).isoformat() for m in replaces}))
    return True


def live_groups(spark: SparkSession, path: str) -> DataFrame:
    """The groups that count, with ``batch`` and ``receipt_month``.  Replaced
    months are left out by their folders' names."""
    known = _published(spark, path)
    if not known:
        return spark.createDataFrame([], GROUPS)
    first = max((b for b, months in known.items() if months == _EVERY_MONTH), default=min(known))
    batches = sorted(b for b in known if b >= first)
    buckets = _buckets(spark, path)
    if buckets:
        groups = spark.table(_table(spark, path, buckets)).filter(F.col("batch").isin(batches))
    else:
        groups = spark.read.schema(GROUPS).option("basePath", path).parquet(*[f"{path}/batch={b}" for b in batches])
    since: dict[str, int] = {}
    for batch in batches:
        if known[batch] != _EVERY_MONTH:
            since.update(dict.fromkeys(known[batch], batch))
    for month, batch in since.items():
        old = F.col("receipt_month").eqNullSafe(F.lit(_dt.date.fromisoformat(month))) & (F.col("batch") < batch)
        groups = groups.filter(~old)
    return groups


def state_events(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`status.parcel_events` gives for the journal of all batches."""
    return events_of_groups(merge_groups(live_groups(spark, path)))


def compact(spark: SparkSession, path: str, batch_id: int) -> bool:
    """Merge all batches into one, published like a batch; False if done before.
    The folders it stands for stay until :func:`remove_replaced`."""
    if not _is_new(spark, path, batch_id):
        return False
    with kept_buckets(spark):
        _write(merge_groups(live_groups(spark, path), "receipt_month"), path, batch_id)
    _publish(spark, path, batch_id, _EVERY_MONTH)
    return True


def remove_replaced(spark: SparkSession, path: str) -> None:
    """Remove what the last compaction stands for, once no reader uses it."""
    known = _published(spark, path)
    last = max((b for b, months in known.items() if months == _EVERY_MONTH), default=None)
    for batch in sorted(b for b in known if last is not None and b < last):
        remove_path(spark, f"{path}/_published/{batch}")
        remove_path(spark, f"{path}/batch={batch}")
