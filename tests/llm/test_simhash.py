"""SimHash groups against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from conftest import words

from millrate.llm import simhash
from millrate.llm.common import stored

FOLD = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_fingerprint(text: str | None, k: int = 3) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, bits: int = 3):
    """(fingerprint, smallest id reachable) of each row."""
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(prints[i], least.get(find(i))) for i in range(len(rows))]


def test_fingerprints():
    rnd = random.Random(1)
    for text in ["", " \n", "a", "A b", "a b c", "É é É x", "a\x1cb c\x85d", words(rnd, 70_000),
                 *(words(rnd, n) for n in (2, 3, 4, 9, 200))]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_every_close_pair_shares_a_key():
    rnd = np.random.default_rng(4)
    a = rnd.integers(0, 1 << 63, 3000).astype(np.uint64) << np.uint64(1) | rnd.integers(0, 2, 3000).astype(np.uint64)
    b = a.copy()
    for k in range(3):  # up to three flipped bits
        b ^= np.uint64(1) << rnd.integers(0, 64, 3000).astype(np.uint64)
    row, key = simhash.golay_keys(a.view(np.int64), near=True)
    query = set(zip(row.tolist(), key.tolist()))
    row, key = simhash.golay_keys(b.view(np.int64), near=False)
    met = {r for r, k in zip(row.tolist(), key.tolist()) if (r, k) in query}
    assert met == set(range(3000))
    assert len(row) == 8 * 3000


def test_components(spark):
    rnd = random.Random(7)
    pairs = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)]
    pairs += [(rnd.randint(2000, 2400), rnd.randint(2000, 2400)) for _ in range(250)]
    pairs = [(min(p), max(p)) for p in pairs if p[0] != p[1]]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {i: find(i) for i in root if find(i) != i}
    got = simhash.components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {r["node"]: r["root"] for r in got} == want


def near_rows():
    rnd = random.Random(9)
    rows = []
    for _ in range(30):
        base = words(rnd, 300).split()
        for _ in range(6):
            mine = list(base)
            mine[rnd.randrange(len(mine))] = "changed"
            rows.append((len(rows), " ".join(mine)))
    return rows


def test_groups(odd, spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(
        odd.selectExpr("doc_id + 10000 as doc_id", "text"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted((r[0] or -1, *g) for r, g in zip(rows, plain_groups(rows)))
    got = sorted((r["doc_id"] or -1, r["fp"] & (1 << 64) - 1, r["component_id"])
                 for r in simhash.near_groups(docs).collect())
    assert got == want
    assert len({g[1] for g in plain_groups(rows[:180])}) < 180


def test_one_of_each_group_stays(odd, empty):
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    groups = {g for _, g in plain_groups(rows) if g is not None}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(groups)
    assert ids.count(None) == 1  # the lonely text without an id
    assert simhash.keep_first(empty).count() == 0
    assert simhash.near_groups(empty).count() == 0


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_are_not_broadcast(spark):
    # Spark sizes the keys as the fingerprints, of which each has 8 to 48.
    nodes = stored(spark.createDataFrame([(1,), (3,), (1 << 40,), (-1,)], "fp long"), "t-nodes")
    found = simhash.links(nodes)
    assert "SortMergeJoin" in _plan(found) and "Broadcast" not in _plan(found)
    assert sorted(map(tuple, found.collect())) == [(1, 3), (1, 1 << 40), (3, 1 << 40)]
