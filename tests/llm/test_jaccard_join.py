"""The Jaccard join against brute force."""

from __future__ import annotations

import random
import re

from conftest import words
from test_simhash import FOLD

from millrate.llm import common
from millrate.llm import jaccard_join as jj
from millrate.llm import production


def plain_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def plain_groups(rows, percent=80):
    """(size, component) of each row (id, text)."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(len(s), least.get(find(i))) for i, s in enumerate(sets)]


def check(docs, percent=80):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(((r[0] is None, r[0] or 0), g) for r, g in zip(rows, plain_groups(rows, percent)))
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), (r["n_shingles"], r["component_id"]))
                 for r in jj.link_groups(docs, percent=percent).collect())
    assert [str(x) for x in got] == [str(x) for x in want]
    return got


def cluster_rows():
    """Groups of near copies around the limit, chains, and texts that share passages only."""
    rnd = random.Random(11)
    rows, passage = [], words(rnd, 60)
    for size, changes in [(60, 3), (40, 5), (30, 9), (25, 1), (2, 2), (3, 4)]:
        base = words(rnd, 150).split()
        for _ in range(size):
            mine = list(base)
            for _ in range(rnd.randint(0, changes)):
                mine[rnd.randrange(len(mine))] = words(rnd, 1)
            rows.append(" ".join(mine))
    chain = words(rnd, 120).split()
    for i in range(40):  # each differs a little more from the first
        chain[3 * i:3 * i + 2] = words(rnd, 2).split()
        rows.append(" ".join(chain))
    rows += [f"{words(rnd, 30)} {passage} {words(rnd, 40)}" for _ in range(60)]
    rows += ["one two three", "one two three", "ONE two three", "one two", "one two three four five",
             "one two three four six"]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_groups(odd, spark):
    docs = spark.createDataFrame(cluster_rows(), "doc_id long, text string").unionByName(
        odd.selectExpr("doc_id + 10000 as doc_id", "text"))
    got = check(docs)
    assert len({g for _, (_, g) in got}) > 80


def test_small_bounds(spark, monkeypatch):
    """Many rounds, no frequent shingles, joined instead of broadcast ids, salted regions."""
    for name, value in dict(PIVOTS=1, MORE=2, FREQUENT=10 ** 9, BROADCAST_NODES=0, SALT_ROWS=7).items():
        monkeypatch.setattr(jj, name, value)
    check(spark.createDataFrame(cluster_rows()[:160], "doc_id long, text string"))


def test_other_limit(spark):
    check(spark.createDataFrame(cluster_rows()[:120], "doc_id long, text string"), percent=60)


def test_bound_of_intersections():
    rnd = random.Random(2)
    base = words(rnd, 900).split()
    texts = [" ".join(base[a:b]) for a, b in ((0, 900), (0, 100), (50, 800), (5, 30), (0, 3))] + [words(rnd, 300)]
    for a in texts:
        for b in texts:
            x, y = jj.shingles(a), jj.shingles(b)
            both = len(set(x.tolist()) & set(y.tolist()))
            assert both == len(plain_set(a) & plain_set(b))
            assert both <= jj.most_common(jj.histogram(x), jj.histogram(y))
    assert jj.most_common(bytes([255] * 16), bytes(16)) == float("inf")


def test_empty(empty):
    assert jj.link_groups(empty).count() == 0


def test_query_columns(spark):
    got = production.op12_jaccard_join(spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]


def test_short_plans(spark, monkeypatch):
    """No plan holds the branches of a whole round: the driver keeps each plan, and a
    string of it for each of its stages."""
    plans = []

    def kept(df, name):
        plans.append((df._jdf.queryExecution().optimizedPlan().collectLeaves().size(), name))
        return common.stored(df, name)

    monkeypatch.setattr(jj, "stored", kept)
    for name, value in dict(PIVOTS=2, MORE=2, FREQUENT=5).items():
        monkeypatch.setattr(jj, name, value)
    check(spark.createDataFrame(cluster_rows()[:160], "doc_id long, text string"))
    assert max(plans)[0] <= 16, sorted(plans)[-8:]
