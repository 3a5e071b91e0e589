"""Quality rules against plain counting."""

from __future__ import annotations

import base64
import random
import re
from collections import Counter

import zstandard
from conftest import words

from millrate.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text: str):
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def samples():
    rnd = random.Random(3)
    out = ["", " \n\t", "a", "# * |\n# * |\n\n", "é\x1cè\x85 \x0b日本"]
    out += [" ".join(rnd.choice("ab") for _ in range(n)) for n in (4, 5, 6, 7, 30, 200)]
    base = words(rnd, 60)
    return out + [base, base + "\n" + base, base + " x " + base, words(rnd, 3000, "abcdefghij"), "same line\n" * 50]


def test_counts():
    for text in samples():
        assert quality.base_counts(text) == plain_counts(text)


def test_bands():
    rnd = random.Random(4)
    rule = quality.Bands()

    def said(text: str) -> str:
        raw = text.encode()
        return rule.verdict(len(raw), *rule.ratios(raw))

    assert said("over and over " * 200) == "repetitive"
    assert said(words(rnd, 2000) + " " + "over and over " * 700) == "repetitive"  # by a chunk
    assert said("".join(chr(rnd.randrange(33, 127)) for _ in range(9000))) == "incompressible"
    assert said(words(rnd, 1500, "abcdefghijklm")) == "ok"
    assert said("") == "ok" and said("short") == "ok"
    raw = words(rnd, 3000).encode()
    whole, low, high = rule.ratios(raw)
    each = [len(zstandard.ZstdCompressor(level=3).compress(raw[k:k + 4096])) / 4096
            for k in range(0, len(raw) - 4095, 4096)]
    assert (low, high) == (min(each), max(each))
    assert whole == len(zstandard.ZstdCompressor(level=3).compress(raw)) / len(raw)


def test_frames(odd, empty):
    rows = {(r["doc_id"], r["n_words"], r["word_chars"]): r for r in quality.judge(odd).collect()}
    for doc in odd.collect():
        counts = plain_counts(doc["text"] or "")
        r = rows[(doc["doc_id"], counts[0], counts[1])]
        assert tuple(r)[1:6] == counts
        assert r["base_failed"] == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert r["kept"] == (not r["base_failed"] and r["verdict"] == "ok")
    assert quality.judge(empty).count() == 0


def base64_words(rnd: random.Random, size: int) -> str:
    s, out = base64.b64encode(rnd.randbytes(size)).decode(), []
    while s:
        k = rnd.randint(4, 12)
        out.append(s[:k])
        s = s[k:]
    return " ".join(out)[:size]


def test_pieces_reach_tails_and_short_texts(spark):
    rnd = random.Random(9)
    prose = words(rnd, 4000, "abcdefghijklm")
    tails = {(4096, 4000): "base64", (2000, 2000): "base64", (9000, 1600): "base64", (3000, 800): "base64",
             (500, 400): "base64", (2000, 1500): "over", (600, 400): "over"}
    texts, want = [], []
    for (n, more), kind in tails.items():
        tail = base64_words(rnd, more) if kind == "base64" else ("over and over " * 200)[:more]
        for text in (prose[:n] + " " + tail, tail + " " + prose[:n], prose[:n // 2] + " " + tail + " " + prose[:n // 2]):
            texts.append(text)
            want.append("incompressible" if kind == "base64" else "repetitive")
    for n in (200, 256, 257, 700, 1024, 4095, 4096, 4097, 9000):
        texts.append(prose[:n])
        want.append("ok")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert [got[i]["verdict"] for i in range(len(texts))] == want
    pack = zstandard.ZstdCompressor(level=3)
    raw = prose[:700].encode()
    each = [len(pack.compress(raw[k:k + 256])) / 256 for k in (0, 128, 256, 384, 444)]
    assert quality.Bands().piece_ratios(raw) == (min(each), max(each))


def test_random_texts_of_any_length_fail():
    rnd = random.Random(10)
    rule = quality.Bands()
    prose = words(rnd, 6000, "abcdefghijklm")

    def said(text: str) -> str:
        raw = text.encode()
        return rule.verdict(len(raw), *rule.ratios(raw))  # by the whole text alone

    for n in (*range(128, 1100, 7), 1023, 2047, 2048, 4095, 5000, 16383, 16384, 30_000):
        assert said(base64_words(rnd, n)) == "incompressible", n
        at = rnd.randrange(1 + len(prose) - n) if n < len(prose) else 0
        assert said(prose[at:at + n]) == "ok", n
    most = [rule.limits(n)[1] for n in range(128, 20_000)]
    assert max(a - b for a, b in zip(most, most[1:])) < 0.002 and sorted(most, reverse=True) == most
    assert rule.limits(127)[1] == float("inf")
