"""Stored ledger tables (roll, attempts, journal, parcels) and their Parquet layout.

All are dealt into the same buckets of ``parcel_id`` and sorted by it there, so
posting, status and the reports join them without a shuffle, and row groups carry
narrow statistics for point lookups.  The journal is also in folders by
``receipt_month``: month reports and month locks prune whole directories.  No
parcel is hot here: an order has 499 attempts at most.

Roll and attempts are built first; journal and parcels when first read.
"""

from __future__ import annotations

import hashlib
import math
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from millrate.functions import rules
from millrate.operators import posting
from millrate.operators.status import parcel_status
from millrate.schemas import JOURNAL_COLUMNS, PARCEL_COLUMNS
from millrate.session import cut_lineage, drop_table, hadoop_path, path_bytes, scratch_path
from millrate.sources import fixtures
from millrate.sources.bucketed import dropped_shuffles, kept_buckets, open_buckets, save_buckets, table_name


@dataclass
class Ledger:
    """The tables a collector works from, as lazily read DataFrames."""

    spark: SparkSession
    sf_dir: str
    paths: dict[str, str]
    buckets: int
    marker: str | None = None

    def _read(self, name: str) -> DataFrame:
        # One DataFrame per table: its file index is listed once, not per query.
        cache = self.__dict__.setdefault("_frames", {})
        if name not in cache:
            if name in _POSTED_TABLES:
                self.finish()
            cache[name] = open_buckets(self.spark, self.paths[name], self.buckets, name == "journal")
        return cache[name]

    def finish(self) -> None:
        """Build journal and parcels unless they are stored."""
        done = self.paths["journal"]
        if done in _FINISHED:
            return
        if self.marker is None or _marked(self.spark, self.marker) is None:
            _post(self)
            if self.marker:
                _mark(self.spark, self.marker, self.buckets)
        _FINISHED.add(done)

    @property
    def roll(self) -> DataFrame:
        """Parcels as imported (status UNPAID)."""
        return self._read("roll")

    @property
    def attempts(self) -> DataFrame:
        return self._read("attempts")

    @property
    def journal(self) -> DataFrame:
        """Posted attempts, reversals and exonerations, January months closed."""
        return self._read("journal")

    @property
    def parcels(self) -> DataFrame:
        """The roll with status derived from the journal (corrected rules)."""
        return self._read("parcels")

    def table(self, name: str) -> DataFrame:
        return self._read(name)


_CACHE: dict[tuple[str, str], Ledger] = {}
#: Journals of this process that are stored.
_FINISHED: set[str] = set()


_POSTED_TABLES = ("journal", "parcels")
_TABLES = ("roll", "attempts", *_POSTED_TABLES)
_SOURCE_TABLES = ("orders", "customer", "lineitem")


def _fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Inputs (path, length and time of every file, listed through the file
    system that holds them) plus the code that derives the ledger."""
    h = hashlib.sha1()
    for name in _SOURCE_TABLES:
        target, fs = hadoop_path(spark, f"{sf_dir}/{name}.parquet")
        found, listed = [], fs.listFiles(target, True)
        while listed.hasNext():
            f = listed.next()
            found.append(f"{f.getPath().toString()}:{f.getLen()}:{f.getModificationTime()}")
        h.update("\n".join(sorted(found)).encode())
    pkg = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for root, dirs, files in sorted(os.walk(pkg)):
        if os.path.basename(root) == "llm":
            continue  # no part of the ledger
        for f in sorted(files):
            if f.endswith(".py"):
                with open(os.path.join(root, f), "rb") as fh:
                    h.update(fh.read())
    return h.hexdigest()[:20]


#: Bytes of source data for each bucket.  A bucket is a task: it sorts its rows in memory.
_BUCKET_BYTES = 64 * 1024 * 1024


def ledger_buckets(spark: SparkSession, sf_dir: str) -> int:
    """Buckets of the stored tables: at least the cluster's parallelism (so jobs on
    them use every core) and one per 64 MB of source data (so that a task's rows fit
    its memory)."""
    total = 0
    for name in _SOURCE_TABLES:
        total += path_bytes(spark, f"{sf_dir}/{name}.parquet")
    return max(spark.sparkContext.defaultParallelism, math.ceil(total / _BUCKET_BYTES))


def _shared_base(spark: SparkSession) -> str | None:
    base = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return base.rstrip("/") if base else None


def _marked(spark: SparkSession, marker: str) -> int | None:
    """The number of buckets in a marker file (None: there is none)."""
    target, fs = hadoop_path(spark, marker)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return int(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _mark(spark: SparkSession, marker: str, buckets: int) -> None:
    # Put in place whole: a reader never meets an empty marker.
    staged, fs = hadoop_path(spark, f"{marker}-{uuid.uuid4().hex[:12]}")
    target, _fs = hadoop_path(spark, marker)
    out = fs.create(staged, True)
    out.write(bytearray(str(buckets), "utf-8"))
    out.close()
    if not fs.rename(staged, target) and not fs.exists(target):
        raise OSError(f"{marker} was not written")


def build_ledger(spark: SparkSession, sf_dir: str, reuse: bool = True, whole: bool = True) -> Ledger:
    """Derive roll/attempts/journal from the driver tables and persist them.

    With ``reuse`` a ledger already written under the shared checkpoint
    directory for the same input files and the same code is read instead of
    rebuilt (marker files are written last, so a failed build is never reused).
    Without ``whole`` journal and parcels wait until they are read.
    """
    mark = _fingerprint(spark, sf_dir)
    key = (spark.sparkContext.applicationId, mark)
    ledger = _CACHE.get(key) if reuse else None
    if ledger is None:
        ledger = _CACHE[key] = _base(spark, sf_dir, mark if reuse else None)
    elif ledger.spark is not spark:
        # Same application, another session: reuse the written tables.
        ledger = Ledger(spark, sf_dir, ledger.paths, ledger.buckets, ledger.marker)
    if whole:
        ledger.finish()
    return ledger


def _base(spark: SparkSession, sf_dir: str, mark: str | None) -> Ledger:
    """A ledger whose roll and attempts are stored."""
    shared = _shared_base(spark) if mark else None
    if shared:
        root = f"{shared}/millrate-ledger-{mark}"
        paths = {name: f"{root}/{name}" for name in _TABLES}
        stored = _marked(spark, f"{root}/_BASE")
        if stored is not None:
            return Ledger(spark, sf_dir, paths, stored, f"{root}/_COMPLETE")
    else:
        paths = {name: scratch_path(spark, f"ledger-{name}") for name in _TABLES}
    n = ledger_buckets(spark, sf_dir)

    def save(df: DataFrame, name: str) -> DataFrame:
        save_buckets(df, table_name(paths[name]), paths[name], n, months=False)
        return open_buckets(spark, paths[name], n, months=False)

    with kept_buckets(spark), dropped_shuffles(spark):
        roll = save(fixtures.roll_from_orders(spark, sf_dir).select(*PARCEL_COLUMNS).repartition(n, "parcel_id"), "roll")
        save(fixtures.attempts_from_lineitem(spark, sf_dir, roll, n), "attempts")
    if shared:
        _mark(spark, f"{root}/_BASE", n)
    return Ledger(spark, sf_dir, paths, n, f"{root}/_COMPLETE" if shared else None)


def _post(ledger: Ledger) -> None:
    """Store the journal and the parcels' status.

    Posting joins two tables of the same buckets, so the posted rows are not stored
    for their few uses but joined anew: no row of them is shuffled, but what the
    reversals look up.
    """
    spark, n, roll, attempts = ledger.spark, ledger.buckets, ledger.roll, ledger.attempts
    paths = ledger.paths
    with kept_buckets(spark), dropped_shuffles(spark):
        posted = posting.post_payments(attempts, roll)
        nsf_rows, _missing = posting.nsf_reversals(posted, fixtures.nsf_requests(attempts))
        exon_rows = posting.exonerate(fixtures.exoneration_requests(roll, posted))
        few = cut_lineage(nsf_rows.unionByName(exon_rows))
        journal = posted.unionByName(few.repartition(n, "parcel_id"))
        closures = cut_lineage(fixtures.january_closures(journal).coalesce(1))
        closed = posting.close_month(journal, closures).select(*JOURNAL_COLUMNS).withColumn(
            "receipt_month", rules.month_start("date_received"))
        save_buckets(closed, table_name(paths["journal"]), paths["journal"], n, months=True)
        drop_table(few)
        drop_table(closures)
        journal = open_buckets(spark, paths["journal"], n, months=True)
        status = parcel_status(roll, journal).select(*PARCEL_COLUMNS)
        save_buckets(status, table_name(paths["parcels"]), paths["parcels"], n, months=False)


def read_tables(spark: SparkSession, roll_path: str, journal_path: str) -> tuple[DataFrame, DataFrame]:
    """Full scans of a stored roll and journal (column pruning is Catalyst's)."""
    return spark.read.parquet(roll_path), spark.read.parquet(journal_path)
