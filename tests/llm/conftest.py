from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("score double, ids string, shard string, slot string, copies string, rate string, n_tokens string, "
         "digest string, fp string, rejected string, key string, tokens string")


def words(rnd: random.Random, n: int, letters: str = "abcdefgh") -> str:
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 8))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """NULLs, empty and very long texts, copies, repeated rows."""
    rnd = random.Random(5)
    long = words(rnd, 60_000)
    plain = words(rnd, 40)
    texts = [None, "", " \t\n", "a", "A", "A", plain, plain.upper(), plain + " end", long, long,
             "it's  two\n\nlines \n x 12", "日本語 テスト １２３", "é " * 40, "x" * 30_000, "<|endoftext|> a", "\x1ca\x85b"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    return rows + [rows[6], rows[6], (None, None, None, None, None), (None, plain, None, None, None),
                   (None, "lonely text without an id", None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with more columns whose names clash with the operators'."""
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    for c in CLASH.split(", "):
        name, kind = c.split()
        docs = docs.selectExpr("*", f"cast(null as {kind}) as {name}")
    return docs


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
