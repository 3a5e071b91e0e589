"""Joins of the bucketed roll and journal: no shuffle, the same rows, hot parcels apart."""

import uuid

import pytest
from pyspark.sql import functions as F

from millrate.operators.status import parcel_status
from millrate.operators.util import money_edge
from millrate.plans import collections as coll
from millrate.plans import monthly, settlement
from millrate.session import scratch_path
from millrate.sources.bucketed import write_colocated

JOBS = {
    "detail": lambda roll, journal: monthly.monthly_detail(journal, roll).select(
        "transaction_id", "parcel_id", "tax_type", "receipt_month", "amount_paid"),
    "paid": coll.paid_by_parcel,
    "settlement": settlement.per_parcel_settlement,
    "status": lambda roll, journal: parcel_status(roll, journal).select("parcel_id", "status", "net_paid"),
}


def _store(spark, parcels, journal, buckets=None):
    return write_colocated(spark, parcels, journal, f"t_{uuid.uuid4().hex[:8]}", scratch_path(spark, "bucketed"), buckets)


@pytest.fixture(scope="module")
def stored(spark, ledger):
    return _store(spark, ledger.parcels, ledger.journal)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("job", JOBS)
def test_no_exchange_below_the_join(spark, ledger, stored, no_broadcast, job):
    assert stored.hot_parcels is None
    plan = stored.each(JOBS[job])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan, plan


def _bag(df):
    return sorted(map(str, money_edge(df).collect()))


@pytest.mark.parametrize("job", JOBS)
def test_hot_parcels_and_unknown_ids(spark, ledger, job, no_broadcast):
    """A parcel with a third of all rows and as many rows without a parcel leave
    the buckets; nothing else does."""
    key = F.col("transaction_id") % 3
    journal = ledger.journal.withColumn(
        "parcel_id", F.when(key == 0, F.lit("P-1")).when(key == 1, F.col("parcel_id")))
    both = _store(spark, ledger.parcels, journal, 6)
    assert sorted(str(r[0]) for r in both.hot_parcels.collect()) == ["None", "P-1"]
    assert both.journal.filter("parcel_id IS NULL OR parcel_id = 'P-1'").isEmpty()
    assert both.journal.count() + both.hot_journal.count() == journal.count()
    assert _bag(both.each(JOBS[job])) == _bag(JOBS[job](ledger.parcels, journal))
    cold = JOBS[job](both.roll.join(F.broadcast(both.hot_parcels), "parcel_id", "left_anti"), both.journal)
    assert "hashpartitioning" not in cold._jdf.queryExecution().executedPlan().toString()


def test_month_folders_are_pruned(stored):
    plan = monthly.monthly_detail(stored.journal, stored.roll, 4, 1998)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(receipt_month" in plan


def test_empty_journal(spark, ledger):
    both = _store(spark, ledger.parcels, ledger.journal.limit(0), 4)
    assert both.each(JOBS["status"]).count() == ledger.parcels.count()
