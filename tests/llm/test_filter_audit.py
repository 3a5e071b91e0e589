"""The filter audit against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
from conftest import words

from millrate.llm import filter_audit as fa
from millrate.llm import production


def plain(rows, labels):
    """All result rows of documents (id, text, lang) and labels (id, quality, toxic)."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, bad in zip("ABCDE", (
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            bool(re.search(r"[#$%&*|]", t)), t in least and (i is None or i > least[t]))) if bad}
        parts[lang or ""].append((fails, i in good, i in toxic))
    out = []
    for part, docs in parts.items():
        total = defaultdict(int)
        mine = []
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                fails = sum(f in d[0] for d in docs)
                total[f] += len(removed)
                mine.append([part, order, step, len(left), len(removed), fails - len(removed),
                             sum(d[0] == {f} for d in docs), sum(d[1] for d in removed), sum(d[2] for d in removed)])
        out += [tuple(r) + (total[r[1][r[2] - 1]],) for r in mine]
    return sorted(out)


def test_against_brute_force(spark, odd):
    rnd = random.Random(3)
    extra = []
    for i in range(300):
        t = words(rnd, rnd.choice([5, 99, 100, 150]), "abcdefghij")
        t = t.upper() if rnd.random() < 0.2 else t
        t += rnd.choice(["", "", " # x", " | y"])
        extra.append((100 + i, t if rnd.random() < 0.8 else "same text", rnd.choice(["de", "en", None, ""])))
    docs = odd.select("doc_id", "text", "lang", "ids", "digest").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string, lang string"), allowMissingColumns=True)
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 400, 2)]
    labels += [(4, 0, 0), (4, 1, 0), (None, 1, 1), (99_999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    want = plain(rows, labels)
    got = fa.audit(docs, table).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        "shapley").collect()
    assert sorted(tuple(r) for r in got) == want


def test_merges():
    rnd = np.random.default_rng(5)
    for _ in range(300):
        a = np.unique(rnd.integers(0, rnd.integers(1, 300), rnd.integers(0, 80)))
        b = np.unique(rnd.integers(0, 300, rnd.integers(0, 200)))
        assert (fa.union(a, b) == np.union1d(a, b)).all()
        assert (fa.subtract(a, b) == np.setdiff1d(a, b)).all()
        assert (fa.subtract(b, a) == np.setdiff1d(b, a)).all()
        assert (fa.intersect(a, b) == np.intersect1d(a, b)).all()
        if len(b):
            assert (fa._places(a, b) == np.searchsorted(b, a)).all()


def test_many_parts(spark, monkeypatch):
    monkeypatch.setattr(fa, "_PARTS", 3)
    rows = [(i, "x #" if i % 3 else "y", f"p{i % 20}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in fa.audit(docs, labels).collect()) == plain(rows, [])


def test_empty(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(empty, labels).count() == 0


def test_query_columns(spark):
    got = production.op13_filter_audit(spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("part", "string"), ("filter_order", "string"), ("step", "int")] + [
        (c, "bigint") for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
