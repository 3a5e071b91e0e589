"""The change log by buckets equals the plain one and joins few rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrate.operators import audit

AT = dt.datetime(2025, 7, 1, 9, 30)
FIELDS = ["status", "owner"]


def _bag(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_plain_change_log(spark, seed):
    rnd = random.Random(seed)

    def value():
        return rnd.choice(("a", "b", "", None))

    before = [(f"P-{i}", value(), value()) for i in range(400)]
    after = [r for r in before if rnd.random() < 0.97]
    after = [(k, o, s) if rnd.random() < 0.05 else (k, s, o) for k, s, o in after]  # values change places
    after += [(f"N-{i}", value(), value()) for i in range(5)]
    b, a = (spark.createDataFrame(rows, "parcel_id string, status string, owner string") for rows in (before, after))
    args = ("parcel_id", FIELDS, "tax_duplicate", AT)
    assert _bag(audit.change_log_by_bucket(b, a, *args)) == _bag(audit.change_log(b, a, *args))


def test_repeated_rows_and_empty_snapshots(spark):
    schema = "parcel_id string, status string, owner string"
    twice = spark.createDataFrame([("P-1", "a", None)] * 2, schema)
    other = spark.createDataFrame([("P-1", None, "a")] * 2, schema)
    none = spark.createDataFrame([], schema)
    args = ("parcel_id", FIELDS, "tax_duplicate", AT)
    for b, a in ((twice, other), (twice, none), (none, twice), (none, none)):
        assert _bag(audit.change_log_by_bucket(b, a, *args)) == _bag(audit.change_log(b, a, *args))
    assert audit.change_log_by_bucket(twice, twice, *args).isEmpty()


def test_few_changes_bring_few_rows_into_the_join(spark):
    before = spark.range(50_000).select(
        F.concat(F.lit("P-"), "id").alias("parcel_id"), F.lit("UNPAID").alias("status"), F.lit("x").alias("owner"))
    changed = F.substring("parcel_id", 3, 9).cast("int") % 1000 == 0
    after = before.withColumn("status", F.when(changed, F.lit("PAID")).otherwise(F.col("status")))
    b, a = audit.changed_buckets(before, after, "parcel_id", FIELDS)
    assert 50 <= b.count() < 2500 and 50 <= a.count() < 2500
