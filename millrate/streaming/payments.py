"""Structured Streaming intake of payment attempts (W1) and duplicate
suppression (W2).

W1 handles each micro-batch in ``foreachBatch`` with the batch path's own
functions: it validates against the roll, re-reads the month-lock table — it
changes between batches — and writes allowed rows to the journal, refused rows
and attempts for unknown parcels to outputs of their own.  All sinks are
idempotent per batch id (a replayed batch overwrites its own directory), so a
restarted query does not duplicate.

W2 keeps the keys seen in a RocksDB state store on the executors' disks.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrate.operators import posting
from millrate.schemas import ATTEMPTS, JOURNAL_COLUMNS
from millrate.session import hadoop_path


def read_attempt_stream(spark: SparkSession, path: str,
                        max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(ATTEMPTS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def stream_payments(spark: SparkSession, attempts_path: str, parcels: DataFrame,
                    lock_table: Callable[[], DataFrame], journal_sink: str,
                    refused_sink: str, unknown_sink: str, checkpoint: str, undated_sink: str | None = None,
                    default_issue: _dt.date | None = None,
                    max_files_per_trigger: int | None = None) -> None:
    """Run the intake stream over everything available now, then stop.

    ``lock_table`` returns the current locked months (column ``lock_month``);
    it is called afresh for every micro-batch.  Accepted, rejected, refused,
    unknown and undated rows add up to the attempts; without a place for undated
    ones a batch that holds any fails.

    A batch is published by its manifest, written after all its outputs:
    :func:`read_published` sees whole batches only, and a retry writes the batch anew.
    """
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # Posted rows feed two writes: held for this batch only.
        posted = posting.post_payments(batch, parcels, default_issue).persist()
        try:
            allowed, refused = posting.split_by_lock_table(posted, lock_table())
            allowed.select(*JOURNAL_COLUMNS).write.mode("overwrite").parquet(
                f"{journal_sink}/batch={batch_id}")
            refused.select(*JOURNAL_COLUMNS).write.mode("overwrite").parquet(
                f"{refused_sink}/batch={batch_id}")
            posting.unknown_parcels(batch, parcels).write.mode("overwrite").parquet(
                f"{unknown_sink}/batch={batch_id}")
            undated = posting.undated_attempts(batch, parcels)
            if undated_sink:
                undated.write.mode("overwrite").parquet(f"{undated_sink}/batch={batch_id}")
            elif not undated.isEmpty():
                raise ValueError("attempts without a date, and no undated_sink for them")
            manifest, fs = hadoop_path(spark, _manifest(journal_sink, batch_id))
            fs.create(manifest, True).close()
        finally:
            posted.unpersist()

    q = (read_attempt_stream(spark, attempts_path, max_files_per_trigger)
         .writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def _manifest(journal_sink: str, batch_id: int) -> str:
    # A folder whose name starts with an underscore is no part of the table beside it.
    return f"{journal_sink}/_published/{batch_id}"


def read_published(spark: SparkSession, sink: str, journal_sink: str) -> DataFrame | None:
    """The rows of an output of :func:`stream_payments` whose batches are complete,
    with column ``batch`` (None: no batch yet).  The batches are listed once, so
    outputs read by one list belong together."""
    folder, fs = hadoop_path(spark, f"{journal_sink}/_published")
    if not fs.exists(folder):
        return None
    batches = sorted(int(f.getPath().getName()) for f in fs.listStatus(folder))
    paths = [f"{sink}/batch={b}" for b in batches]
    return spark.read.option("basePath", sink).parquet(*paths) if paths else None


_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_dedupe(spark: SparkSession, attempts_path: str, sink: str, checkpoint: str,
                  max_files_per_trigger: int | None = None) -> None:
    """Drop repeated attempts, whatever their dates and order of arrival.

    A check repeats if parcel, check number, amount and installment are those of
    an earlier row.  Cash has no number of its own, so only a row with the same
    ``seq`` (sent twice) is a repeat.  The key of every different attempt stays
    in state, in RocksDB.
    """
    stream = read_attempt_stream(spark, attempts_path, max_files_per_trigger)
    keyed = stream.withColumn("cash_seq", F.when(F.col("check_number") == "CASH", F.col("seq")))
    deduped = keyed.dropDuplicates(["parcel_id", "check_number", "amount", "installment_num", "cash_seq"])
    before = spark.conf.get(_STATE_STORE, None)
    spark.conf.set(_STATE_STORE, _ROCKSDB)
    try:
        q = (deduped.drop("cash_seq").writeStream.format("parquet").option("path", sink)
             .option("checkpointLocation", checkpoint).outputMode("append")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_STATE_STORE)
        else:
            spark.conf.set(_STATE_STORE, before)
