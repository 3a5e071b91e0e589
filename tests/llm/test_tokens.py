"""Byte-level BPE, token files and token counts against the public libraries."""

from __future__ import annotations

import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from millrate.llm import byte_bpe, token_counts, token_files
from millrate.session import scratch_path

RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
ALPHABET = "abcdefgh IJK \n\tABC0123456789.,''’!?éüß漢字🙂\x1c 　\x00strevmldΣσİǅ́"


@pytest.fixture(scope="module")
def texts(odd):
    rnd = random.Random(2)
    made = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(1, 200))) for _ in range(400)]
    made += ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(1, 40))) for _ in range(600)]
    return [r["text"] or "" for r in odd.select("text").collect()] + made + [
        "'s'sword it's !'s ''s 'S 'RE", "<|endoftext|> x<|startoftext|>", "a \n b", " a", "a ", "ab" * 300]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def ids_of(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


def test_codec(texts, reference):
    codec = byte_bpe.Codec(RANKS, P.PATTERN)
    for text, raw in zip(texts, codec.encode(texts)):
        assert ids_of(raw) == reference.encode_ordinary(text)
        assert codec.decode(ids_of(raw)) == text.encode()


def test_both_trees_merge_alike(reference):
    codec = byte_bpe.Codec(RANKS, P.PATTERN)
    rnd = random.Random(3)
    batch = [bytes(rnd.randrange(256) for _ in range(rnd.randint(1, 64))) for _ in range(300)]
    assert [ids_of(x) for x in codec._merge_many(batch, 64)] == [codec._merge_long(x) for x in batch]


def test_small_tables_give_the_same(texts, monkeypatch):
    whole = byte_bpe.Codec(RANKS, P.PATTERN).encode(texts)
    monkeypatch.setattr(byte_bpe, "KNOWN", 5)
    monkeypatch.setattr(byte_bpe, "SPACED", 5)
    codec = byte_bpe.Codec(RANKS, P.PATTERN)
    assert [codec.encode([t])[0] for t in texts[:100]] == whole[:100]


def test_bpe_frames(odd, empty, reference):
    encoded = byte_bpe.encode(odd, RANKS, P.PATTERN)
    decoded = byte_bpe.decode(encoded, RANKS, P.PATTERN)
    want = sorted((r["text"] or "").encode() for r in odd.collect())
    assert sorted(bytes(r["decoded"]) for r in decoded.collect()) == want
    for r in encoded.collect():
        assert r["n_tokens"] == len(r["ids"])
    assert byte_bpe.encode(empty, RANKS, P.PATTERN).count() == 0
    digests = byte_bpe.round_trip(odd, RANKS, P.PATTERN)
    assert digests.count() == odd.count()


def test_variable_length_code():
    rnd = np.random.default_rng(0)
    ranks = np.concatenate([rnd.integers(0, 300, 1001), rnd.integers(0, 1 << 32, 1000),
                            [0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1]]).astype(np.uint32)
    control, data = token_files.pack(ranks)
    assert len(control) == -(-len(ranks) // 4)
    assert (token_files.unpack(control, data, len(ranks)) == ranks).all()
    assert len(token_files.unpack(*token_files.pack(ranks[:0]), 0)) == 0


def test_encoder(texts, library):
    coder = token_files.Encoder(WORDS)
    for text, raw in zip(texts, coder.encode(texts)):
        assert ids_of(raw) == library.encode(text, add_special_tokens=False).ids


def test_files(odd, empty, spark, library, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 50)
    path = scratch_path(spark, "t-token-files")
    ids = token_files.encode_to_files(odd, path, WORDS)
    got = token_files.read(spark, path, ids).orderBy("start").collect()
    keys = [(-1 if r["doc_id"] is None else r["doc_id"]) for r in got]
    assert keys == sorted(keys) and len(got) == odd.count()
    texts = {}
    for r in odd.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    start = 0
    for r in got:
        mine = ids_of(bytes(r["tokens"]))
        assert r["start"] == start
        start += len(mine)
        assert mine in [library.encode(t, add_special_tokens=False).ids + [1] for t in texts[r["doc_id"]]]
    digests = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in token_files.digests(
        token_files.read(spark, path, ids)).collect()}
    assert digests == {(r["doc_id"], r["start"]): zlib.crc32(bytes(r["tokens"])) for r in got}
    path = scratch_path(spark, "t-token-files")
    assert token_files.read(spark, path, token_files.encode_to_files(empty, path, WORDS)).count() == 0


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(WORDS)


def counted(texts, library):
    return [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts(texts, library, counter):
    assert counter.count(texts).tolist() == counted(texts, library)
    assert counter.count([]).tolist() == [] and counter.count(["", ""]).tolist() == [0, 0]


def test_chunks_and_tables_of_any_size(texts, library, counter, monkeypatch):
    want = counted(texts[30:], library)
    for chunk, slab, states in ((1, 40, 30), (7, 64, 50), (64, 1000, 10), (256, 100, 5)):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        monkeypatch.setattr(token_counts, "SLAB", slab)
        monkeypatch.setattr(token_counts, "STATES", states)
        assert counter.count(texts[30:]).tolist() == want


def test_count_frames(odd, empty, library):
    rows = token_counts.count_tokens(odd, WORDS, limit=100).collect()
    want = sorted((len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids))
                  for r in odd.collect())
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in rows)
    assert token_counts.count_tokens(empty, WORDS).count() == 0


def test_tables_keep_no_long_pieces(reference):
    """Unspaced texts leave nothing behind in a worker."""
    from millrate.llm import production, token_files
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcdefghij0123") for _ in range(9000)) + "é日" * 200 for _ in range(20)]
    coder = byte_bpe.Codec(production.BYTE_BPE, P.PATTERN)
    got = coder.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [reference.encode_ordinary(t) for t in texts]
    assert all(len(k.encode()) <= byte_bpe.WIDE for k in coder.known)
    assert all(len(k) <= byte_bpe.WIDE for k in coder.spaced)
    enc = token_files.Encoder(production.WORD_BPE)
    want = [enc.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == want
    assert all(len(k) <= token_files.LONGEST for k in enc.known)


def test_newer_letters(library):
    """Characters that Python's tables don't know: as the library has them."""
    from millrate.llm import production, token_files
    enc = token_files.Encoder(production.WORD_BPE)
    texts = [f"It's 12 a{chr(c)}b {chr(c)}x" for c in (0x1C89, 0x1C8A, 0x105C0, 0x10D50, 0x2FFFC, 0x16EA0, 0x378)]
    want = [enc.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == want


def test_letters_beyond_ascii_cost_little_more():
    """A look for unknown characters doesn't outweigh the encoding (best of three)."""
    import time

    from millrate.llm import production, token_files, word_bpe
    enc = token_files.Encoder(production.WORD_BPE)

    def seconds(text: str) -> float:
        took = []
        for _ in range(4):  # the first one meets the word
            start = time.process_time()
            enc.encode([text])
            took.append(time.process_time() - start)
        return min(took[1:])

    assert seconds("wörd " * 200_000) < 6 * seconds("word " * 200_000)
    assert not word_bpe.has_unassigned("wörd 漢字") and word_bpe.has_unassigned("a͸b")


def test_punctuation_behind_letters(library):
    from millrate.llm import production, token_files
    enc = token_files.Encoder(production.WORD_BPE)
    texts = ["end. end., it's it' 's x'll'. a_b_ c__ d\"'s e'. f'd f'x 1. 1a. g1. ... '. h\\|` É. é'."]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids_of(x) for x in enc.encode(texts)] == want
