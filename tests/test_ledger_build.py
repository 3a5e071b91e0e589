"""The ledger's tables share buckets: posting and status join them without a shuffle,
and journal and parcels are built only when they are read."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from millrate.operators import posting, replay
from millrate.operators.status import parcel_status
from millrate.plans import monthly
from millrate.session import hadoop_path, scratch_path
from millrate.sources import fixtures
from millrate.sources.bucketed import open_buckets, table_name, write_colocated
from millrate.sources.tables import build_ledger


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _sources(spark, orders, lines):
    folder = scratch_path(spark, "t-sources")
    spark.createDataFrame([(c, f"Customer {c}") for c in range(3)], "c_custkey long, c_name string").write.parquet(
        f"{folder}/customer.parquet")
    spark.createDataFrame([(o, 1, "P" if (o or 0) % 2 else "O", 900.0, dt.datetime(1998, 1, 5)) for o in orders],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                          "o_orderdate timestamp").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(
        [(o, p, s, n, 1.0, price, 0.0, 0.0, "N", "O", dt.datetime(1998, 2, 1)) for o, p, s, n, price in lines],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(
        f"{folder}/lineitem.parquet")
    return folder


def test_posting_and_status_shuffle_nothing(ledger, no_broadcast):
    for df in (posting.post_payments(ledger.attempts, ledger.roll), parcel_status(ledger.roll, ledger.journal),
               monthly.monthly_detail(ledger.journal, ledger.parcels)):
        plan = _plan(df)
        assert "SortMergeJoin" in plan and "Exchange" not in plan, plan


def test_close_month_does_not_shuffle_the_journal(ledger, no_broadcast):
    months = ledger.journal.sparkSession.createDataFrame([(1, 1998), (1, 1999)], "month int, year int")
    plan = _plan(posting.close_month(ledger.journal, months))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan, plan
    locked = _plan(posting.split_by_month_lock(ledger.journal, ledger.journal)[1])
    assert "BroadcastHashJoin" in locked and "SortMergeJoin" not in locked, locked


def test_journal_is_built_when_read(spark):
    folder = _sources(spark, [1, 2, 2, None], [(1, 5, 6, 1, 2.0), (2, 7, 8, 1, 3.0), (None, 1, 1, 1, 4.0), (9, 1, 1, 1, 5.0)])
    L = build_ledger(spark, folder, reuse=False, whole=False)
    assert L.attempts.count() == 3  # a line of a repeated order meets both bills

    def stored(name):
        path, fs = hadoop_path(spark, L.paths[name])
        return fs.exists(path)

    assert not stored("journal") and not stored("parcels")
    assert L.journal.filter("transaction_type != 'NSF_REVERSAL'").count() == 5
    assert L.parcels.count() == 4 and L.roll.count() == 4
    assert stored("parcels")


def test_equal_lines_are_numbered_apart(spark):
    """Lines of one number, part and supplier: each has its own id, whatever else differs."""
    folder = _sources(spark, [3], [(3, 4, 5, 1, price) for price in (1.0, 2.0, 2.0)] + [(3, 1, 5, 1, 9.0)])
    roll = fixtures.roll_from_orders(spark, folder)
    got = fixtures.attempts_from_lineitem(spark, folder, roll).orderBy("seq").select("seq", "date").collect()
    assert [r[0] for r in got] == [3001, 3002, 3003, 3004]
    assert [r[1] for r in got] == [dt.date(1998, 1, 6)] + [dt.date(1998, 1, 9)] * 3
    assert fixtures.attempts_from_lineitem(spark, folder, roll).filter(F.col("parcel_id") != "P-3").isEmpty()


def test_replay_does_not_shuffle_rows_by_month(spark, ledger, no_broadcast):
    import __spark_entry__ as entry
    for df in replay.replay(entry.replay_commands(ledger), ledger.roll):
        plan = _plan(df)
        assert "SortMergeJoin [_m" not in plan, plan


def test_dealt_tables_are_colocated_as_they_are(spark, ledger):
    """As many files as buckets (and months): nothing was dealt anew, no row is lost."""
    path = scratch_path(spark, "t-dealt")
    both = write_colocated(spark, ledger.parcels, ledger.journal, path.rsplit("/", 1)[1].replace("-", "_"), path,
                           ledger.buckets, dealt=True)
    months = ledger.journal.select("receipt_month").distinct().count()
    assert len(both.roll.inputFiles()) <= ledger.buckets
    assert len(both.journal.inputFiles()) <= ledger.buckets * months
    assert both.journal.count() == ledger.journal.count() and both.roll.count() == ledger.parcels.count()
    got, want = (monthly.monthly_detail(j, p).groupBy("tax_type").agg(F.count("*"), F.sum("amount_paid")).collect()
                 for j, p in ((both.journal, both.roll), (ledger.journal, ledger.parcels)))
    assert sorted(got) == sorted(want)


def test_stream_files_follow_the_buckets(spark, ledger):
    import __spark_entry__ as entry
    src = entry._attempt_stream_dir(spark, ledger, with_repeats=False)
    files = len(spark.read.parquet(src).inputFiles())
    assert files <= ledger.buckets and entry._files_per_batch(ledger) * 3 >= files
    assert spark.read.parquet(src).count() == ledger.attempts.count()


def test_tables_of_another_application_are_read_whole(spark):
    """A catalog that doesn't know the stored tables: all rows, still in buckets."""
    folder = _sources(spark, [1, 2], [(1, 5, 6, 1, 2.0), (2, 7, 8, 1, 3.0)])
    L = build_ledger(spark, folder, reuse=False)
    rows = sorted(map(str, L.journal.collect()))
    assert len(rows) >= 2
    spark.sql(f"DROP TABLE {table_name(L.paths['journal'])}")
    again = open_buckets(spark, L.paths["journal"], L.buckets, months=True)
    assert sorted(map(str, again.select(L.journal.columns).collect())) == rows
    assert "Exchange" not in _plan(again.groupBy("parcel_id").count())


def _shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {x for x in blocks.mkString(",").split(",") if x.startswith("shuffle_")}


def test_the_build_leaves_no_shuffle_files(spark):
    folder = _sources(spark, range(1, 40), [(o, 5, 6, n, 2.0) for o in range(1, 40) for n in (1, 2, 3)])
    before = _shuffle_files(spark)
    L = build_ledger(spark, folder, reuse=False)
    until = time.time() + 4
    while (left := _shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)  # they are removed in the background
    assert not left
    assert (L.roll.count(), L.attempts.count()) == (39, 117)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"  # as it was
