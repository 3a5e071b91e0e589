"""Language, toxicity and mixing: exact parts against brute force, learned
parts by held-out accuracy."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from conftest import words

from millrate.llm import language_id, mixing, toxicity

SOUNDS = {"aa": "ba be bi mo ma".split(), "bb": "stra krü zen pfo schli".split(), "cc": "ño lla que zo rra".split()}


def speak(rnd: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rnd.choice(SOUNDS[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rnd = random.Random(1)
    rows = [(i, speak(rnd, lang, rnd.randint(5, 120)), lang) for i in range(180) for lang in [rnd.choice("aa bb cc".split())]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language(spoken, odd, empty):
    model = language_id.fit(spoken, spoken.filter("doc_id % 3 > 0"), per_lang=40, clusters=3)
    assert model.langs == ["aa", "bb", "cc"] and len(model.centroids) <= 9
    held = language_id.predict(spoken.filter("doc_id % 3 = 0"), model, ["doc_id", "lang"]).collect()
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 and not r["rejected"] for r in held)
    got = language_id.predict(odd, model, odd.columns)
    assert got.columns[-4:] == ["lang_pred", "score_", "cosine", "rejected_"] and got.count() == odd.count()
    for r in got.collect():
        has = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not has)
        assert has or (r["score_"] == 0 and r["rejected_"])
    far = model.judge(["日本語 テスト テスト 漢字 日本語 " * 30])[0]
    assert far[3]
    assert language_id.predict(empty, model, ["doc_id"]).count() == 0
    none = language_id.fit(empty, empty)
    assert {r["lang_pred"] for r in language_id.predict(odd, none, ["doc_id"]).collect()} == {"und"}


def test_centroid_judgement_by_hand():
    rnd = random.Random(2)
    texts = [speak(rnd, lang, 50) for lang in SOUNDS for _ in range(4)]
    x = language_id.vectors(np.array([language_id.counts(t) for t in texts]), np.ones(2 << language_id.BUCKET_BITS))
    centroids, low = language_id.cluster(x, 3)
    own = (x @ centroids.T).argmax(axis=1)
    assert len(set(own[:4])) == len(set(own[4:8])) == 1 and len(set(own)) == 3
    for j in range(3):
        member = x[own == j].sum(axis=0)
        assert np.allclose(centroids[j], member / np.linalg.norm(member))
        assert np.isclose(low[j], (x[own == j] @ centroids[j]).min())


SCRAPS = ["Die tz.", "+1 (168) 555-0133 token = 16", "zq " * 40, "Onatedble", "wq"]


def test_clusters_of_two_dialects_with_outliers():
    rnd = random.Random(12)
    texts = [speak(rnd, lang, rnd.randint(20, 90)) for lang in ("aa", "bb") for _ in range(60)] + SCRAPS
    x = language_id.vectors(np.array([language_id.counts(t) for t in texts]), np.ones(2 << language_id.BUCKET_BITS))
    for k in (2, 3, 4):
        centroids, _ = language_id.cluster(x, k)
        own = (x @ centroids.T).argmax(axis=1)
        assert 2 <= len(centroids) <= k and np.bincount(own).min() >= 7  # 5% of 125
        assert not set(own[:60]) & set(own[60:120])
    for n in (1, 2, 3, 5):  # few texts, or the same one over and over
        assert len(language_id.cluster(x[:n], 4)[0]) <= max(1, n // 2)
        assert len(language_id.cluster(x[[0] * n], 4)[0]) == 1


UNLEARNED = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja "
    "omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem "
    "i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel "
    "bírván, egymással szemben testvéri szellemben kell hogy viseltessenek."]


def test_far_texts_are_rejected_despite_scraps(spark):
    rnd = random.Random(13)
    rows = [(i, speak(rnd, lang, rnd.randint(5, 120)), lang) for i in range(1350)
            for lang in [rnd.choice("aa bb cc".split())]]
    rows += [(3000 + 10 * k + i, scrap, lang) for k, lang in enumerate(SOUNDS) for i, scrap in enumerate(SCRAPS[:2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, docs.filter("doc_id % 3 > 0 OR doc_id >= 3000"), per_lang=600, clusters=1)
    held = [(t, lang) for i, t, lang in rows if i < 3000 and i % 3 == 0]
    assert [(r[0], r[3]) for r in model.judge([t for t, _ in held])] == [(lang, False) for _, lang in held]
    noise = [words(rnd, n, "abcdefghijklmnopqrstuvwxyz") for n in (10, 20, 50, 100, 300) for _ in range(20)]
    assert all(r[3] for r in model.judge(noise + UNLEARNED))


def brute_marginals(score, trans):
    n = len(score)
    weight = {}
    for tags in itertools.product((0, 1), repeat=n):
        chain = (0, *tags, 0)
        total = sum(trans[a, b] for a, b in zip(chain, chain[1:])) + sum(s for s, t in zip(score, tags) if t)
        weight[tags] = np.exp(total)
    z = sum(weight.values())
    return [sum(w for tags, w in weight.items() if tags[k]) / z for k in range(n)]


@pytest.mark.parametrize("block", [1, 2, 3, 128])
def test_forward_backward(block, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rnd = np.random.default_rng(1)
    sizes = np.array([1, 7, 0, 3, 8, 2])
    score, trans = rnd.normal(0, 2, sizes.sum()), rnd.normal(0, 1, (2, 2))
    left, right = toxicity.chain(score, sizes, trans)
    got = 1 / (1 + np.exp(-(left + score + right)))
    want, at = [], 0
    for n in sizes:
        want += brute_marginals(score[at:at + n], trans)
        at += n
    assert np.allclose(got, want)


NORMAL = [a + b for a in "ba be bi mo ma tra ko lu".split() for b in "ba be bi mo ma tra ko lu".split()]


def toxic_rows(n: int = 400):
    rnd = random.Random(6)
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        text = words(rnd, rnd.randint(20, 80)).split()
        for _ in range(bad * rnd.randint(1, 3)):
            text.insert(rnd.randrange(len(text)), rnd.choice(["vile", "VILER!", "zorking"]))
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_toxicity(spark, odd, empty):
    docs = spark.createDataFrame(toxic_rows(), "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs.filter("doc_id % 5 > 0"), per_class=300)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for i, text, toxic in toxic_rows():
        assert 0 <= got[i]["score"] <= 1 and (got[i]["score"] >= toxicity.THRESHOLD) == bool(toxic)
        spans = {text[s["start"]:s["end"]] for s in got[i]["spans"]}
        assert spans == set(text.split()) & {"vile", "VILER!", "zorking"}
    assert toxicity.score(odd, model).count() == odd.count()
    assert all(r["score"] < 0.5 for r in toxicity.score(odd, model).collect())
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(docs, docs.filter("toxic = 0"))
    assert none is None and toxicity.score(docs, none).agg({"score": "max"}).first()[0] == 0


def test_rare_toxic_words_are_learned(spark):
    """A word of 0.6% of the toxic texts, in a sample as large on the clean side."""
    rnd = random.Random(14)
    rows = []
    for i in range(5000):
        text = [rnd.choice(NORMAL) for _ in range(30)]
        if i % 2:
            text.insert(rnd.randrange(30), "grulnix" if i % 167 == 1 else "vile")
        rows.append((i, " ".join(text), i % 2))
    assert 12 <= sum("grulnix" in t for _, t, _ in rows) <= 17
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs)
    score, spans = model.judge(["mo grulnix ba", "mo bebi ba"])[0]
    assert [(s["start"], s["end"]) for s in spans] == [(3, 10)] and score >= 0.5
    assert not model.judge([t for _, t, bad in rows if not bad][0:1])[0][1]


def test_floor_follows_chance():
    ratios = [60.0] * 50 + [24.0] * 10 + [18.0] * 40
    assert toxicity._above_chance(ratios, 1_000) == 100      # exp(-9) * 1,000 = 0.12
    assert toxicity._above_chance(ratios, 20_000) == 60      # 2.5 of 100, but exp(-12) * 20,000 = 0.12
    assert toxicity._above_chance(ratios, 1_000_000) == 50   # 6.1 of 60
    assert toxicity._above_chance([5.0], 1_000) == 0 and toxicity._above_chance([], 0) == 0


def test_mixing(spark, odd, empty):
    rnd = random.Random(8)
    rows = [(i, speak(rnd, lang, rnd.randint(1, 60)), lang) for i in range(240)
            for lang in [rnd.choice(["aa", "aa", "aa", "bb", "cc"])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    targets = {"aa": 1.0, "bb": 2.0, "cc": 1.0}
    mixed = mixing.Mixed(docs.drop("domain"), docs.filter("doc_id < 150"), targets)
    got = mixed.rated().toPandas()
    n, p = got["n_tokens"].to_numpy(float), np.array(got["posterior"].tolist())
    assert np.allclose(p.sum(axis=1), 1)
    assert n.tolist() == [len(t.split()) for t in got["text"]]
    right = [mixed.domains[k] for k in p.argmax(axis=1)]
    truth = {i: d for i, _, d in rows}
    assert sum(r == truth[i] for r, i in zip(right, got["doc_id"])) > 0.9 * len(rows)
    # The same least squares by numpy.
    base, rate, gram = n @ p, np.ones(len(n)), (p * n[:, None]).T @ p
    goal = base.sum() * np.array([targets[d] for d in mixed.domains]) / 4
    before, momentum = rate, 1.0
    for _ in mixed.steps:
        longer = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        y = rate + (momentum - 1) / longer * (rate - before)
        before, rate, momentum = rate, np.maximum(0, y - p @ np.linalg.solve(gram, y * n @ p - goal)), longer
    assert np.allclose(got["rate"], rate, atol=1e-6)
    assert np.allclose(got["rate"].to_numpy() * n @ p, goal, rtol=1e-4) and got["rate"].min() >= 0
    assert (abs(got["copies"] - got["rate"]) < 1).all()
    assert mixed.drawn().count() == got["copies"].sum()
    assert "Python" not in mixed.drawn()._jdf.queryExecution().toString()
    other = mixing.Mixed(odd, docs.select("doc_id", "domain").filter("doc_id < 10"), targets)
    assert other.drawn().columns == odd.columns
    assert other.rated().count() == odd.count() and other.tokens == "n_tokens_"
    assert mixing.Mixed(empty, docs, targets).drawn().count() == 0
    flat = mixing.Mixed(docs, docs.filter("false"), targets).rated().select("posterior").first()[0]
    assert np.allclose(flat, 1 / 3)
    hard = mixing.Mixed(docs.drop("domain"), docs.filter("doc_id < 150"), {"aa": 0.0, "bb": 0.02, "cc": 0.98})
    assert len(hard.steps) > 1 and hard.left < 0.02 * sum(hard.goal)  # rates at the bound
    assert hard.rated().filter("rate < 0").count() == 0
    with pytest.raises(ValueError):
        mixing.Mixed(docs, docs, {"aa": -1.0})
