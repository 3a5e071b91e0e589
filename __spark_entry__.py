"""

Every query reads the driver's tables (through the ledger built from
``orders``, ``customer`` and ``lineitem``) and runs over whole tables.
Money leaves as DOUBLE (cast at this edge only; the library keeps decimals).
"""

from __future__ import annotations

import datetime as _dt
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from millrate.operators import audit, maintenance, posting, replay, state  # noqa: E402
from millrate.operators.status import parcel_status, running_balance, status_of_events  # noqa: E402
from millrate.operators.util import money_edge  # noqa: E402
from millrate.plans import collections as coll  # noqa: E402
from millrate.plans import documents, intake, lookup, monthly, settlement  # noqa: E402
from millrate.schemas import ATTEMPTS, JOURNAL, JOURNAL_COLUMNS, PARCEL_COLUMNS  # noqa: E402
from millrate.session import ensure_checkpoint_dir, scratch_path  # noqa: E402
from millrate.sources import bucketed, fixtures  # noqa: E402
from millrate.sources.extraction import parse_check_extractions  # noqa: E402
from millrate.sinks import writers  # noqa: E402
from millrate.sources.roll_csv import read_labels, read_roll  # noqa: E402
from millrate.sources.tables import Ledger, build_ledger  # noqa: E402
from millrate.streaming import payments as stream  # noqa: E402

# Run parameters of the registered queries (fixed values).
AS_OF = _dt.date(2000, 6, 30)
RUN_AT = _dt.datetime(2025, 7, 1, 9, 30, 0)
TAX_YEAR = 2025
LOOKUP_TERM = "Customer#000000042"
AUDIT_TAIL_N = 20

SF_SMOKE = "/root/testdata/sf0.001"


def _ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    ensure_checkpoint_dir(spark)
    return build_ledger(spark, sf_dir, whole=False)


# --- stand-in command inputs built from the roll (rows only) -------------------
def _okey(col: str = "parcel_id") -> F.Column:
    return F.regexp_extract(col, r"^P-(\d+)$", 1).try_cast("long")


def _reimport(current: DataFrame) -> DataFrame:
    """A re-imported roll file: every 4th parcel twice (revised), new ids too."""
    k = _okey()
    base = current.filter(k % 4 == 0)
    old = base.withColumn("owner_name", F.concat("owner_name", F.lit(" (old)"))) \
        .withColumn("row_no", k * 2)
    new = base.withColumn("owner_name", F.when(
            k % 12 == 0, F.concat(F.upper("owner_name"), F.lit(', "Jr"\nEstate'))).otherwise(F.upper("owner_name"))) \
        .withColumn("face_tax_amount", (F.col("face_tax_amount") + F.lit(1)).cast("decimal(18,2)")) \
        .withColumn("row_no", k * 2 + 1)
    fresh = current.filter(k % 16 == 0).withColumn("row_no", k * 2 + 1).withColumn(
        "parcel_id", F.concat(F.lit("P-N"), k.cast("string")))
    return old.unionByName(new).unionByName(fresh)


def _interim_requests(current: DataFrame) -> DataFrame:
    k = _okey()
    base = current.filter(k % 9 == 0).select(
        F.concat(F.lit("P-"), (k * 2).cast("string")).alias("parcel_id"),
        F.concat(F.lit("Interim "), F.col("owner_name")).alias("owner_name"),
        F.concat((k * 2).cast("string"), F.lit(" New Rd")).alias("property_address"),
        F.col("assessment_value"), "face_tax_amount", "discount_amount", "penalty_amount",
        F.date_add("bill_issue_date", 30).alias("bill_issue_date"), (k * 10).alias("seq"))
    again = base.filter(_okey() % 4 == 0).withColumn("seq", F.col("seq") + 1) \
        .withColumn("owner_name", F.concat(F.lit("Repeat "), F.col("owner_name")))
    return base.unionByName(again)


def _patches(current: DataFrame) -> DataFrame:
    k = _okey()
    p = current.filter(k % 13 == 0).select(
        "parcel_id",
        F.when(k % 2 == 0, F.upper("owner_name")).otherwise(F.lit("")).alias("new_name"),
        F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(" Lake Rd"))).alias("new_address"),
        k.alias("seq"))
    missing = current.filter(k % 131 == 0).select(
        F.concat(F.lit("P-M"), k.cast("string")).alias("parcel_id"),
        F.lit("Nobody").alias("new_name"), F.lit(None).cast("string").alias("new_address"),
        (k + 1).alias("seq"))
    return p.unionByName(missing)


def _closures(journal: DataFrame) -> DataFrame:
    return fixtures.january_closures(journal)


def _open_journal(L: Ledger) -> DataFrame:
    return L.journal.withColumn("is_closed", F.lit(False))


def _roll_csv_path(spark: SparkSession, L: Ledger) -> str:
    key = "roll_csv"
    if key not in L.paths:
        path = scratch_path(spark, "roll-csv")
        L.roll.select(*[c for c in PARCEL_COLUMNS if c not in ("is_interim", "status")]) \
            .withColumn("is_installment_plan", F.col("is_installment_plan").cast("int")) \
            .write.option("header", True).csv(path)
        L.paths[key] = path
    return L.paths[key]


def _attempt_stream_dir(spark: SparkSession, L: Ledger, with_repeats: bool) -> str:
    key = "attempt_stream_dup" if with_repeats else "attempt_stream"
    if key not in L.paths:
        path = scratch_path(spark, key)
        a = L.attempts
        if with_repeats:
            a = a.unionByName(a.filter(F.col("seq") % 10 == 0))
        else:
            a = fixtures.orphan_attempts(a)
        with bucketed.kept_buckets(spark):  # a file a bucket
            a.write.parquet(path)
        L.paths[key] = path
    return L.paths[key]


def _files_per_batch(L: Ledger) -> int:
    """Files of a stream's batch: the stream takes three batches or so, of any size."""
    return max(1, -(-L.buckets // 3))


def _lock_table_path(L: Ledger) -> str:
    if "locks" not in L.paths:
        path = scratch_path(L.spark, "locks")
        posting.locked_months(L.journal).write.parquet(path)
        L.paths["locks"] = path
    return L.paths["locks"]


def prepare_inputs(spark: SparkSession, sf_dir: str) -> None:
    """Materialise the stand-in input files some queries read (roll and
    label CSVs, extraction texts, stream source folders, the lock table).
    Queries do this lazily on first use; the benchmark does it up front and
    reports its time separately."""
    L = _ledger(spark, sf_dir)
    _roll_csv_path(spark, L)
    _labels_csv_path(L)
    _extractions(L)
    _attempt_stream_dir(spark, L, with_repeats=False)
    _attempt_stream_dir(spark, L, with_repeats=True)
    _lock_table_path(L)


# --- queries ------------------------------------------------------------------
def _q(fn: Callable[[Ledger], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return money_edge(fn(_ledger(spark, sf_dir)))
    run.__doc__ = fn.__doc__
    return run


def _journal_cols(df: DataFrame) -> DataFrame:
    return df.select(*JOURNAL_COLUMNS)


def q_read_roll(L: Ledger) -> DataFrame:
    return read_roll(L.spark, _roll_csv_path(L.spark, L)).drop("row_no")


def q_payment_period(L: Ledger) -> DataFrame:
    v = posting.validate_attempts(L.attempts, L.roll)
    return v.select(F.col("seq").alias("transaction_id"), "parcel_id",
                    F.col("date").alias("postmark_date"), "bill_issue_date", "payment_period")


def q_expected_amount(L: Ledger) -> DataFrame:
    v = posting.validate_attempts(L.attempts, L.roll)
    return v.select(F.col("seq").alias("transaction_id"), "payment_period", "expected_amount")


def q_validate_payments(L: Ledger) -> DataFrame:
    v = posting.validate_attempts(L.attempts, L.roll)
    return v.select(F.col("seq").alias("transaction_id"), "parcel_id", "amount",
                    "payment_period", "expected_amount", "validation_code", "is_valid")


def q_validation_summary(L: Ledger) -> DataFrame:
    v = posting.validate_attempts(L.attempts, L.roll)
    return v.groupBy("validation_code").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.sum("amount").cast("decimal(18,2)").alias("amount_total"))


def q_validation_messages(L: Ledger) -> DataFrame:
    v = posting.validate_attempts(L.attempts, L.roll)
    return v.select(F.col("seq").alias("transaction_id"), "validation_code", "message")


def q_validation_messages_corrected(L: Ledger) -> DataFrame:
    v = posting.validate_attempts(L.attempts, L.roll, message_semantics="corrected")
    return v.select(F.col("seq").alias("transaction_id"), "validation_code", "message")


def q_post_payments(L: Ledger) -> DataFrame:
    return _journal_cols(posting.post_payments(L.attempts, L.roll))


def q_unknown_parcels(L: Ledger) -> DataFrame:
    return posting.unknown_parcels(fixtures.orphan_attempts(L.attempts), L.roll)


def q_undated_attempts(L: Ledger) -> DataFrame:
    return posting.undated_attempts(fixtures.undated(L.attempts), L.roll)


def q_post_payments_undated(L: Ledger) -> DataFrame:
    return _journal_cols(posting.post_payments(fixtures.undated(L.attempts), L.roll))


def q_record_payments(L: Ledger) -> DataFrame:
    rows = L.attempts.select(F.col("seq").alias("transaction_id"),
                             F.col("date").alias("date_received"), "parcel_id",
                             F.col("amount").alias("amount_paid"), "check_number")
    return posting.append_journal(None, rows)


def q_exonerations(L: Ledger) -> DataFrame:
    posted = posting.post_payments(L.attempts, L.roll)
    return _journal_cols(posting.exonerate(fixtures.exoneration_requests(L.roll, posted)))


def q_nsf_reversals(L: Ledger) -> DataFrame:
    posted = posting.post_payments(L.attempts, L.roll)
    rows, _ = posting.nsf_reversals(posted, fixtures.nsf_requests(L.attempts))
    return _journal_cols(rows)


def q_nsf_reversals_literal(L: Ledger) -> DataFrame:
    posted = posting.post_payments(L.attempts, L.roll)
    rows, _ = posting.nsf_reversals(posted, fixtures.nsf_requests(L.attempts), "literal")
    return _journal_cols(rows)


def q_close_month(L: Ledger) -> DataFrame:
    j = _open_journal(L)
    return posting.close_month(j, _closures(j)).select(
        "transaction_id", "date_received", "is_closed")


def q_close_month_counts(L: Ledger) -> DataFrame:
    j = _open_journal(L)
    return posting.close_month_counts(j, _closures(j))


def q_locked_months(L: Ledger) -> DataFrame:
    return posting.locked_months(L.journal)


def q_month_lock_refused(L: Ledger) -> DataFrame:
    batch = posting.post_payments(L.attempts, L.roll)
    _, refused = posting.split_by_month_lock(batch, L.journal)
    return _journal_cols(refused)


def q_parcel_status(L: Ledger) -> DataFrame:
    return parcel_status(L.roll, L.journal).select("parcel_id", "status", "net_paid",
                                                   "exonerated")


def q_parcel_status_literal(L: Ledger) -> DataFrame:
    return parcel_status(L.roll, L.journal, "literal").select("parcel_id", "status")


def q_running_balance(L: Ledger) -> DataFrame:
    return running_balance(L.journal, L.roll)


def q_upsert_parcels(L: Ledger) -> DataFrame:
    return maintenance.upsert_parcels(L.parcels, _reimport(L.parcels))


def q_upsert_parcels_literal(L: Ledger) -> DataFrame:
    return maintenance.upsert_parcels(L.parcels, _reimport(L.parcels), semantics="literal")


def q_add_interim(L: Ledger) -> DataFrame:
    roll, _ = maintenance.add_interim(L.parcels, _interim_requests(L.parcels))
    return roll


def q_interim_rejects(L: Ledger) -> DataFrame:
    _, rej = maintenance.add_interim(L.parcels, _interim_requests(L.parcels))
    return rej.select("parcel_id", "seq", "reason")


def q_update_parcels(L: Ledger) -> DataFrame:
    roll, _ = maintenance.update_parcels(L.parcels, _patches(L.parcels))
    return roll


def q_update_rejects(L: Ledger) -> DataFrame:
    _, rej = maintenance.update_parcels(L.parcels, _patches(L.parcels))
    return rej.select("parcel_id", "seq", "reason")


def q_orphan_transactions(L: Ledger) -> DataFrame:
    j = fixtures.with_orphans(L.journal)
    return _journal_cols(j.join(L.roll.select("parcel_id"), "parcel_id", "left_anti"))


def q_monthly_detail(L: Ledger) -> DataFrame:
    return monthly.monthly_detail(L.journal, L.parcels).select(
        *JOURNAL_COLUMNS, "tax_type", "receipt_month")


def q_monthly_summary(L: Ledger) -> DataFrame:
    return monthly.monthly_summary(monthly.monthly_detail(L.journal, L.parcels))


def q_monthly_summary_literal(L: Ledger) -> DataFrame:
    return monthly.monthly_summary(monthly.monthly_detail(L.journal, L.parcels), types=None)


def q_monthly_summary_rollup(L: Ledger) -> DataFrame:
    return monthly.monthly_summary_rollup(monthly.monthly_detail(L.journal, L.parcels))


def q_remittance_advice(L: Ledger) -> DataFrame:
    d = monthly.monthly_detail(L.journal, L.parcels)
    return monthly.remittance_advice(d)


def q_remittance_advice_literal(L: Ledger) -> DataFrame:
    d = monthly.monthly_detail(L.journal, L.parcels)
    return monthly.remittance_advice(d, types=None)


def q_monthly_adjustments(L: Ledger) -> DataFrame:
    return monthly.monthly_adjustments(monthly.monthly_detail(L.journal, L.parcels))


def q_settlement(L: Ledger) -> DataFrame:
    return settlement.settlement(L.roll, L.journal)


def q_settlement_literal(L: Ledger) -> DataFrame:
    return settlement.settlement_literal(L.roll, L.journal)


def q_settlement_exceptions(L: Ledger) -> DataFrame:
    return settlement.settlement_exceptions(L.roll, L.journal)


def q_label_sheet(L: Ledger) -> DataFrame:
    return documents.label_sheet(coll.mailing_labels(L.parcels))


def q_lookup(L: Ledger) -> DataFrame:
    return lookup.lookup(L.parcels, LOOKUP_TERM, AS_OF)


def q_bill_run(L: Ledger) -> DataFrame:
    return documents.bill_run(L.parcels, "Township_County", RUN_AT.date())


def q_bill_run_literal(L: Ledger) -> DataFrame:
    return documents.bill_run(L.parcels, "School", RUN_AT.date(), semantics="literal")


def q_receipts(L: Ledger) -> DataFrame:
    return documents.receipts(L.journal, L.parcels, RUN_AT)


def q_rejection_letters(L: Ledger) -> DataFrame:
    return documents.rejection_letters(L.journal, L.parcels)


def _extractions(L: Ledger) -> DataFrame:
    """Model output texts, stored once per ledger as the intake table."""
    key = "extractions"
    if key not in L.paths:
        path = scratch_path(L.spark, key)
        fixtures.check_extraction_texts(L.attempts).write.parquet(path)
        L.paths[key] = path
    return L.spark.read.parquet(L.paths[key])


def q_check_extractions(L: Ledger) -> DataFrame:
    return parse_check_extractions(_extractions(L), as_of=AS_OF)


def q_memo_parcel(L: Ledger) -> DataFrame:
    return parse_check_extractions(_extractions(L)).filter("parse_ok").select(
        "extraction_id", "memo", "found_parcel_id")


def q_ingest_payments(L: Ledger) -> DataFrame:
    return _journal_cols(intake.ingest_payments(_extractions(L), L.roll, AS_OF))


def q_review_queue(L: Ledger) -> DataFrame:
    return intake.review_queue(_extractions(L), L.roll, AS_OF)


def _change_log(L: Ledger, log: Callable = audit.change_log) -> DataFrame:
    after, _ = maintenance.update_parcels(L.parcels, _patches(L.parcels))
    parcels_log = log(L.roll, after, "parcel_id", ["status", "owner_name", "mailing_address"],
                      "tax_duplicate", RUN_AT)
    return parcels_log.unionByName(audit.journal_insert_log(L.journal, RUN_AT))


def q_system_events(L: Ledger) -> DataFrame:
    j = _open_journal(L)
    patches = _patches(L.parcels)
    _, refused = maintenance.update_parcels(L.parcels, patches)
    patched = patches.join(refused, ["parcel_id", "seq"], "left_anti")
    roll, _ = maintenance.add_interim(L.parcels, _interim_requests(L.parcels))
    interim = roll.join(L.parcels.select("parcel_id"), "parcel_id", "left_anti")
    return audit.system_events(j, RUN_AT, posting.close_month_counts(j, _closures(j)), patched, interim)


def _read_sink(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream's output folder; empty (with the schema) if no batch committed."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _streamed(L: Ledger, part: str) -> str:
    """Run the intake stream once per ledger; its sinks."""
    if "stream_payments" not in L.paths:
        spark = L.spark
        src = _attempt_stream_dir(spark, L, with_repeats=False)
        sinks = [scratch_path(spark, n) for n in ("stream-journal", "stream-refused", "stream-unknown")]
        locks = _lock_table_path(L)
        stream.stream_payments(spark, src, L.roll,
                               lambda: spark.read.parquet(locks), *sinks,
                               scratch_path(spark, "stream-ckpt"), scratch_path(spark, "stream-undated"),
                               max_files_per_trigger=_files_per_batch(L))
        L.paths.update(zip(("stream_payments", "stream_refused", "stream_unknown"), sinks))
    return L.paths[part]


def q_stream_payments(L: Ledger) -> DataFrame:
    return _read_sink(L.spark, _streamed(L, "stream_payments"), JOURNAL).select(*JOURNAL_COLUMNS)


def q_stream_refused(L: Ledger) -> DataFrame:
    return _read_sink(L.spark, _streamed(L, "stream_refused"), JOURNAL).select(*JOURNAL_COLUMNS)


def q_stream_unknown(L: Ledger) -> DataFrame:
    return _read_sink(L.spark, _streamed(L, "stream_unknown"), ATTEMPTS).select(*ATTEMPTS.names)


def q_stream_dedupe(L: Ledger) -> DataFrame:
    spark = L.spark
    src = _attempt_stream_dir(spark, L, with_repeats=True)
    sink = scratch_path(spark, "stream-dedupe")
    stream.stream_dedupe(spark, src, sink, scratch_path(spark, "stream-dedupe-ckpt"),
                         max_files_per_trigger=2 * _files_per_batch(L))  # repeats have files of their own
    return _read_sink(spark, sink, ATTEMPTS).select(
        "parcel_id", "check_number", "amount", "installment_num",
        F.when(F.col("check_number") == "CASH", F.col("seq")).alias("cash_seq"))


def q_status_report_lines(L: Ledger) -> DataFrame:
    return coll.status_report_lines(coll.status_kpis(L.parcels, L.journal),
                                    coll.status_breakdown(L.parcels),
                                    coll.status_by_tax_type(L.parcels, L.journal), RUN_AT)


def _labels_csv_path(L: Ledger) -> str:
    if "labels_csv" not in L.paths:
        path = scratch_path(L.spark, "labels-csv")
        writers.write_labels_csv(coll.mailing_labels(L.parcels), path)
        L.paths["labels_csv"] = path
    return L.paths["labels_csv"]


def q_labels_csv(L: Ledger) -> DataFrame:
    """Mailing labels written as the Name,Address CSV and read back."""
    return read_labels(L.spark, _labels_csv_path(L)).select("name", "address")


def q_import_roll(L: Ledger) -> DataFrame:
    """The re-import written as CSV files in row order, read and upserted: quoted
    commas, quotes and line ends in names, the last of repeated rows wins."""
    if "import_csv" not in L.paths:
        path = scratch_path(L.spark, "import-csv")
        rows = _reimport(L.parcels).repartitionByRange(4, "row_no").sortWithinPartitions("row_no")
        writers.write_csv(rows.select(*[c for c in PARCEL_COLUMNS if c not in ("is_interim", "status")])
                          .withColumn("is_installment_plan", F.col("is_installment_plan").cast("int")), path)
        L.paths["import_csv"] = path
    return maintenance.upsert_parcels(L.parcels, read_roll(L.spark, L.paths["import_csv"]), semantics="literal")


def _csv_again(L: Ledger, df: DataFrame, name: str, write: Callable = writers.write_csv) -> DataFrame:
    """``df`` written as CSV and read again with its types.  The files are whole
    journals or rolls as text, only to be read here: they are compressed."""
    path = scratch_path(L.spark, name)
    write(df, path, compression="gzip")
    kinds = df.schema if write is writers.write_csv else writers.turnover_schema(df)
    return L.spark.read.schema(kinds).option("header", True).option("escape", '"').option(
        "multiLine", True).csv(path)


def q_monthly_csv(L: Ledger) -> DataFrame:
    return _csv_again(L, monthly.monthly_detail(L.journal, L.parcels), "monthly-csv")


def q_return_list_csv(L: Ledger) -> DataFrame:
    return _csv_again(L, coll.return_list(L.parcels), "return-csv")


def q_turnover_csv(L: Ledger) -> DataFrame:
    return _csv_again(L, coll.turnover_report(L.parcels, TAX_YEAR), "turnover-csv", writers.write_turnover)


def q_closed_version(L: Ledger) -> DataFrame:
    """A stored ledger, a version of its closed months, and both read as one."""
    base, version = scratch_path(L.spark, "ledger-open"), scratch_path(L.spark, "ledger-closed")
    writers.write_ledger(_open_journal(L).select(*JOURNAL_COLUMNS), base)
    writers.close_month_partitions(L.spark, base, _closures(L.journal), version)
    return writers.read_version(L.spark, base, version).select(*JOURNAL_COLUMNS, "receipt_month")


def replay_commands(L: Ledger) -> DataFrame:
    """Ordered commands: every attempt, the reversal and exoneration requests,
    and a close of each January placed mid-way through its attempts' seqs."""
    a = L.attempts
    pays = a.select("seq", F.lit("pay").alias("command"), "parcel_id", "amount", "date",
                    "check_number", "installment_num")
    nsf = fixtures.nsf_requests(a).select("seq", F.lit("nsf").alias("command"),
                                          F.col("transaction_id").alias("tx_id"), "date")
    posted = posting.post_payments(a, L.roll)
    exon = fixtures.exoneration_requests(L.roll, posted).select(
        "seq", F.lit("exonerate").alias("command"), "parcel_id", "amount", "date", "reason")
    jan = a.filter(F.month("date") == 1).groupBy(F.year("date").alias("year")).agg(
        (((F.min("seq") + F.max("seq")) / 2).cast("long") / 1000).cast("long").alias("_k"))
    closes = jan.select((F.col("_k") * 1000 + 700).alias("seq"),
                        F.lit("close_month").alias("command"), F.lit(1).alias("month"), "year")
    return pays.unionByName(nsf, allowMissingColumns=True) \
        .unionByName(exon, allowMissingColumns=True) \
        .unionByName(closes, allowMissingColumns=True)


def _replayed(L: Ledger, part: str) -> DataFrame:
    """Replay once per ledger; journal and refused rows are written tables."""
    if "replay_journal" not in L.paths:
        journal, refused = replay.replay(replay_commands(L), L.roll)
        for name, df in (("replay_journal", journal), ("replay_refused", refused)):
            path = scratch_path(L.spark, name)
            df.write.parquet(path)
            L.paths[name] = path
    return L.spark.read.parquet(L.paths[part])


def q_replay_journal(L: Ledger) -> DataFrame:
    return _replayed(L, "replay_journal")


def q_replay_refused(L: Ledger) -> DataFrame:
    return _replayed(L, "replay_refused")


def _colocated(L: Ledger) -> bucketed.CoLocated:
    """Roll and journal in buckets of parcel_id, stored once per ledger."""
    if "colocated" not in L.paths:
        path = scratch_path(L.spark, "colocated")
        bucketed.write_colocated(L.spark, L.parcels, L.journal, path.rsplit("/", 1)[1].replace("-", "_"), path,
                                 L.buckets, dealt=True)
        L.paths["colocated"] = path
    path = L.paths["colocated"]
    return bucketed.open_colocated(L.spark, path.rsplit("/", 1)[1].replace("-", "_"), path)


def q_colocated_monthly_summary(L: Ledger) -> DataFrame:
    detail = _colocated(L).each(lambda roll, journal: monthly.monthly_detail(journal, roll))
    return monthly.monthly_summary(detail)


def q_colocated_status_by_tax_type(L: Ledger) -> DataFrame:
    return coll.paid_by_tax_type(_colocated(L).each(coll.paid_by_parcel))


def q_colocated_settlement(L: Ledger) -> DataFrame:
    return settlement.settlement_totals(_colocated(L).each(settlement.per_parcel_settlement))


def q_payer_sketches(L: Ledger) -> DataFrame:
    """Exact numbers of paying parcels by month, year and over all, and whether the
    stored sketches of the months, merged, come within 3% of them."""
    if "payer_sketches" not in L.paths:
        path = scratch_path(L.spark, "payer-sketches")
        monthly.payer_sketches(monthly.monthly_detail(L.journal, L.parcels)).write.parquet(path)
        L.paths["payer_sketches"] = path
    spans = {"month": F.date_format("receipt_month", "yyyy-MM"), "year": F.date_format("receipt_month", "yyyy"),
             "all": F.lit("all")}
    kept = L.spark.read.parquet(L.paths["payer_sketches"])
    paid = monthly.monthly_detail(L.journal, L.parcels).filter(F.col("transaction_type") == "PAYMENT")

    def over(span: F.Column) -> DataFrame:
        about = monthly.payers_of(kept.withColumn("span", span), "span", "tax_type")
        exact = paid.groupBy(span.alias("span"), "tax_type").agg(F.count_distinct("parcel_id").alias("exact"))
        return exact.join(about, ["span", "tax_type"], "left").select(
            "span", "tax_type", F.col("exact").alias("parcels_paid"),
            (F.abs(F.col("payers") - F.col("exact")) * 100 <= F.col("exact") * 3).alias("sketch_within_3_percent"))

    return over(spans["month"]).unionByName(over(spans["year"])).unionByName(over(spans["all"]))


def _status_state(L: Ledger) -> str:
    """The status state after three batches, in which the amounts of each January are
    twice what they should be, a batch that gives these months anew, and a compaction."""
    if "status_state" not in L.paths:
        path, j = scratch_path(L.spark, "status-state"), L.journal
        january = F.month("date_received") == 1
        months = [r[0] for r in j.filter(january).select("receipt_month").distinct().collect()]
        wrong = j.withColumn("amount_paid", F.when(january, (F.col("amount_paid") * 2).cast("decimal(18,2)"))
                             .otherwise(F.col("amount_paid")))
        for k in range(3):
            state.apply_batch(L.spark, path, wrong.filter(F.col("transaction_id") % 3 == k), k, buckets=L.buckets)
        state.apply_batch(L.spark, path, j.filter(january), 3, months)
        state.compact(L.spark, path, 4)
        L.paths["status_state"] = path
    return L.paths["status_state"]


def q_status_from_batches(L: Ledger) -> DataFrame:
    return status_of_events(L.roll, state.state_events(L.spark, _status_state(L))).select(
        "parcel_id", "status", "net_paid", "exonerated")


def q_settlement_from_batches(L: Ledger) -> DataFrame:
    st = status_of_events(L.roll, state.state_events(L.spark, _status_state(L)))
    return settlement.settlement_totals(settlement.settlement_terms(st))


LEDGER_QUERIES: dict[str, Callable[[Ledger], DataFrame]] = {
    "scan_parcels": lambda L: L.parcels.select(*PARCEL_COLUMNS),
    "scan_journal": lambda L: L.journal.select(*JOURNAL_COLUMNS, "receipt_month"),
    "read_roll": q_read_roll,
    "bill_schedule": lambda L: lookup.bill_schedule(L.roll),
    "installment_schedule": lambda L: lookup.installment_schedule(L.roll),
    "payment_period": q_payment_period,
    "expected_amount": q_expected_amount,
    "validate_payments": q_validate_payments,
    "validation_summary": q_validation_summary,
    "validation_messages": q_validation_messages,
    "validation_messages_corrected": q_validation_messages_corrected,
    "amount_due": lambda L: lookup.amount_due(L.parcels, AS_OF),
    "post_payments": q_post_payments,
    "unknown_parcels": q_unknown_parcels,
    "undated_attempts": q_undated_attempts,
    "post_payments_undated": q_post_payments_undated,
    "record_payments": q_record_payments,
    "exonerations": q_exonerations,
    "nsf_reversals": q_nsf_reversals,
    "nsf_reversals_literal": q_nsf_reversals_literal,
    "close_month": q_close_month,
    "close_month_counts": q_close_month_counts,
    "locked_months": q_locked_months,
    "month_lock_refused": q_month_lock_refused,
    "parcel_status": q_parcel_status,
    "parcel_status_literal": q_parcel_status_literal,
    "running_balance": q_running_balance,
    "upsert_parcels": q_upsert_parcels,
    "upsert_parcels_literal": q_upsert_parcels_literal,
    "add_interim": q_add_interim,
    "interim_rejects": q_interim_rejects,
    "update_parcels": q_update_parcels,
    "update_rejects": q_update_rejects,
    "orphan_transactions": q_orphan_transactions,
    "monthly_detail": q_monthly_detail,
    "monthly_summary": q_monthly_summary,
    "monthly_summary_literal": q_monthly_summary_literal,
    "monthly_summary_rollup": q_monthly_summary_rollup,
    "remittance_advice": q_remittance_advice,
    "remittance_advice_literal": q_remittance_advice_literal,
    "monthly_adjustments": q_monthly_adjustments,
    "return_list": lambda L: coll.return_list(L.parcels),
    "turnover_report": lambda L: coll.turnover_report(L.parcels, TAX_YEAR),
    "settlement": q_settlement,
    "settlement_literal": q_settlement_literal,
    "settlement_exceptions": q_settlement_exceptions,
    "deposit_slip": lambda L: coll.deposit_slip(L.journal),
    "deposit_totals": lambda L: coll.deposit_totals(L.journal),
    "deposit_totals_literal": lambda L: coll.deposit_totals(L.journal, include_rejected=True),
    "deposit_slip_text": lambda L: coll.deposit_slip_text(L.journal),
    "mailing_labels": lambda L: coll.mailing_labels(L.parcels),
    "labels_csv": q_labels_csv,
    "label_sheet": q_label_sheet,
    "status_kpis": lambda L: coll.status_kpis(L.parcels, L.journal),
    "status_breakdown": lambda L: coll.status_breakdown(L.parcels),
    "status_by_tax_type": lambda L: coll.status_by_tax_type(L.parcels, L.journal),
    "status_report_lines": q_status_report_lines,
    "dashboard_kpis": lambda L: coll.dashboard_kpis(L.parcels, L.journal),
    "dashboard_revenue": lambda L: coll.dashboard_revenue(L.parcels, L.journal),
    "recent_activity": lambda L: coll.recent_activity(L.journal),
    "lookup": q_lookup,
    "parcel_history": lambda L: lookup.parcel_history(L.journal, L.parcels),
    "bill_run": q_bill_run,
    "bill_run_literal": q_bill_run_literal,
    "receipts": q_receipts,
    "rejection_letters": q_rejection_letters,
    "check_extractions": q_check_extractions,
    "memo_parcel": q_memo_parcel,
    "ingest_payments": q_ingest_payments,
    "review_queue": q_review_queue,
    "duplicate_payments": lambda L: intake.duplicate_payments(L.journal),
    "change_log": _change_log,
    "payer_sketches": q_payer_sketches,
    "change_log_by_bucket": lambda L: _change_log(L, audit.change_log_by_bucket),
    "system_events": q_system_events,
    "audit_tail": lambda L: audit.audit_tail(_change_log(L), AUDIT_TAIL_N),
    "replay_journal": q_replay_journal,
    "replay_refused": q_replay_refused,
    "stream_payments": q_stream_payments,
    "stream_refused": q_stream_refused,
    "stream_unknown": q_stream_unknown,
    "stream_dedupe": q_stream_dedupe,
    "import_roll": q_import_roll,
    "monthly_csv": q_monthly_csv,
    "return_list_csv": q_return_list_csv,
    "turnover_csv": q_turnover_csv,
    "closed_version": q_closed_version,
    "colocated_monthly_summary": q_colocated_monthly_summary,
    "colocated_status_by_tax_type": q_colocated_status_by_tax_type,
    "colocated_settlement": q_colocated_settlement,
    "status_from_batches": q_status_from_batches,
    "settlement_from_batches": q_settlement_from_batches,
}


def _llm():
    """The registry of the corpus operators, or None where they are absent."""
    try:
        from millrate.llm import registry
    except ImportError:
        return None
    return registry


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: monthly collection summary by tax type and period at sf0.001."""
    return queries()["monthly_summary"](spark, SF_SMOKE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    llm = _llm()
    return {name: _q(fn) for name, fn in LEDGER_QUERIES.items()} | (llm.queries() if llm else {})


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for each key (views of the driver tables pre-registered)."""
    from oracle_sql import ORACLE
    llm = _llm()
    return dict(ORACLE) | (llm.oracle_sql() if llm else {})
