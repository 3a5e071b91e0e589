"""Hard negatives against brute force, and the exact products."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrate.llm import hard_negatives as hn
from millrate.llm import production

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, positives string, role string, cell string"


def plain(rows, anchor):
    """(anchor, positive, rank, negative, scores) of rows (id, vector, label)."""
    usable = {}
    for i, v, lab in rows:
        if i is None or v is None or lab is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        key = (lab, v)
        if i not in usable or key < usable[i]:
            usable[i] = key
    data = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, (lab, v) in usable.items()]
    out = []
    for i, lab, v in data:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in data if j != i)
        for ps, p in [(-s, j) for s, j, other in scored if other == lab][:5]:
            window = [(-s, j) for s, j, other in scored if other != lab and 30 * ps <= -100 * s <= 90 * ps]
            out += [(i, p, rank, j, ps, s) for rank, (s, j) in enumerate(window[:10], 1)]
    return sorted(out)


def mined(spark, rows, anchor=lambda c: c % 10 == 0):
    docs = spark.createDataFrame([(i, v, lab, None, None, None, None) for i, v, lab in rows], SCHEMA)
    return sorted(tuple(r) for r in hn.mine(docs, anchor(F.col("vec_id"))).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def some_rows(seed, n=400, width=12):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0.2, 0.5) for _ in range(width)], rnd.randrange(3)) for i in range(n)]
    hot = [0.5] * width
    rows += [(n + i, hot, i % 2) for i in range(200)]  # a third of all rows tie
    rows += [(None, hot, 1), (5000, None, 1), (5010, [None, 1.0], 1), (5020, [float("nan")], 1),
             (5030, [float("inf"), 1.0], 2), (5040, hot, None), (5050, [], 1), (5060, [1.0], 1),
             (5070, [0.25] * (width + 3), 0), rows[0], rows[0], (10, [9.0] * width, 2), (20, hot, -1)]
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = some_rows(3)
    want = plain(rows, lambda i: i % 10 == 0)
    assert len(want) > 500
    assert mined(spark, rows) == want
    # The same with many groups of anchors, few scores at once and often settled candidates.
    monkeypatch.setattr(hn, "GROUP", 17)
    assert mined(spark, rows[:150]) == plain(rows[:150], lambda i: i % 10 == 0)


def test_many_small_steps(monkeypatch):
    """A cell gives the same best whatever is held at once."""
    best = hn.Best(3, 2)
    monkeypatch.setattr(hn, "GATHER", 1)
    for slot, score, ids in [([0, 0, 1], [5, 5, -1], [9, 3, 1]), ([0, 2], [7, 0], [8, 4]), ([0], [5], [1])]:
        best.add(*(np.array(x, dtype=np.int64) for x in (slot, score, ids)))
    best.settle()
    assert list(zip(best.slot, best.score, best.id)) == [(0, 7, 8), (0, 5, 1), (1, -1, 1), (2, 0, 4)]


def test_exact_products():
    rnd = np.random.default_rng(1)
    for size, width in [(5, 1), (300, 64), (100_000, 3000), (2 ** 24, 30)]:
        a, b = (rnd.integers(-size, size, (7, width)).astype(float) for _ in range(2))
        a[0], b[0] = size, -size
        a[1], b[1] = size, size
        primes = hn.primes_for(width * size * size)
        got = hn.scores(hn.residues(a, primes), hn.residues(b, primes), primes)
        assert (got == a.astype(np.int64) @ b.astype(np.int64).T).all()


def test_too_large_scores_raise(spark):
    docs = spark.createDataFrame([(0, [1e30, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(ValueError):
        hn.mine(docs, F.col("vec_id") % 10 == 0)


def test_empty(spark):
    docs = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hn.mine(docs, F.col("vec_id") % 10 == 0).count() == 0


def test_query_columns(spark):
    got = production.op11_hard_negatives(spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"),
                          ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
