"""Exact dedup and sharding against plain Python."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from conftest import odd_rows  # noqa: F401
from pyspark.sql import functions as F

from millrate.llm import common, exact_dedup, sharding

FOLD = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(FOLD)].append(r[0])
    out = []
    for body, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(body.encode()).hexdigest()) for i in ids]
    return Counter(out)


def test_groups(odd):
    got = exact_dedup.exact_groups(odd, salts=4).collect()
    assert Counter(map(tuple, got)) == expected([(r["doc_id"], r["text"]) for r in odd.collect()])


def test_shared_digests_are_told_apart_by_text(odd):
    got = exact_dedup.exact_groups(odd, salts=4, digest=lambda t: F.substring(F.sha2(t, 256), 1, 1)).collect()
    want = expected([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == Counter(
        {k[:3]: 0 for k in want}) + sum((Counter({k[:3]: n}) for k, n in want.items()), Counter())


def test_one_row_of_each_group_stays(odd):
    got = exact_dedup.keep_latest(odd)
    assert got.columns == odd.columns
    bodies = Counter((r["text"] or "").translate(FOLD) for r in got.collect())
    assert set(bodies.values()) == {1}
    assert set(bodies) == {(r["text"] or "").translate(FOLD) for r in odd.collect()}


def test_empty_tables(empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.keep_latest(empty).count() == 0
    assert sharding.place(empty).count() == 0


def test_lookup_table_is_filled_by_turns():
    names = [f"n{i}" for i in range(7)]
    table = sharding.lookup_table(names, 101)
    taken, left = {}, {k: [] for k in range(7)}
    for k, name in enumerate(names):
        h = hashlib.md5(name.encode()).hexdigest()
        at, step = int(h[:15], 16) % 101, int(h[15:30], 16) % 100 + 1
        left[k] = [(at + j * step) % 101 for j in range(101)]
        assert sorted(left[k]) == list(range(101))
    for turn in range(101):
        k = turn % 7
        taken[next(s for s in left[k] if s not in taken)] = k
    assert table == [taken[s] for s in range(101)]
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1


def test_few_slots_move_when_a_shard_is_added():
    a = sharding.lookup_table([f"n{i}" for i in range(10)], 2003)
    b = sharding.lookup_table([f"n{i}" for i in range(11)], 2003)
    assert sum(x != y and y != 10 for x, y in zip(a, b)) < 0.1 * 2003


def test_bad_tables():
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 100)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"], 101)


def test_placement(odd):
    got = sharding.place(odd)
    assert set(got.columns) == set(odd.columns) and got.count() == odd.count()
    table = sharding.lookup_table()
    for r in got.select("doc_id", "text", "slot", "shard").collect():
        key = str(r["doc_id"]) if r["doc_id"] is not None else r["text"] or ""
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.SIZE
        assert (r["slot"], r["shard"]) == (slot, sharding.SHARDS[table[slot]])
    assert not [x for x in got._jdf.queryExecution().toString().split() if "Python" in x]


def test_written_shards(odd, spark):
    from millrate.session import scratch_path
    path = scratch_path(spark, "t-shards")
    sharding.write_shards(odd.select("doc_id", "text"), path, files_per_shard=2)
    assert spark.read.parquet(path).count() == odd.count()


def test_columns_of_the_stages_own_names(spark):
    from millrate.llm import simhash
    rows = [(1, "some words here", "a", "b", "c"), (2, "SOME words here", "d", "e", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id string, __digest string, __hash string")
    assert [tuple(r) for r in exact_dedup.keep_latest(docs).collect()] == rows[1:]
    assert [tuple(r) for r in simhash.keep_first(docs).collect()] == rows[:1]


def test_many_kept_keys_are_not_broadcast(spark):
    # The files of 100,001 keys are small enough for Spark, their hash table isn't.
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (-1, "d")], "k long, x string")
    some = spark.range(1, 11).selectExpr("id as k", "1 + (id = 2)::int as n")
    many = spark.range(1, 100_002).selectExpr("id as k", "1 + (id = 2)::int as n")
    for kept, join in ((some, "BroadcastHashJoin"), (many, "SortMergeJoin")):
        found = common.one_each(rows, kept, ["k"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count(f"{join} [k") == 2
        assert sorted(r["k"] for r in found.collect()) == [1, 2]
