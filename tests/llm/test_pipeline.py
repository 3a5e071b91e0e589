"""The pipeline's stages, one by one, against plain Python."""

from __future__ import annotations

import base64
from collections import Counter

import corpus_pipeline
import public_tokenizers as P
import tiktoken
from test_exact_sharding import FOLD
from test_simhash import plain_groups

from millrate.llm import production
from millrate.llm.common import read, stored

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SMALL, "documents")
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SMALL), f"t-{name}")
        rows = [r.asDict() for r in before.collect()]
        if name != "byte_bpe":
            assert docs.columns == before.columns
            known = {tuple(r.values()) for r in rows}
            assert all(tuple(r) in known for r in docs.collect())
            ids[name] = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        if name == "language_id":
            said = production.language_model(before).judge([r["text"] for r in rows])
            assert ids[name] == Counter(r["doc_id"] for r, s in zip(rows, said) if not s[3])
            assert sum(ids[name].values()) > 0.98 * len(rows)
        elif name == "exact_dedup":
            last = {}
            for r in sorted(rows, key=lambda r: r["doc_id"]):
                last[(r["text"] or "").translate(FOLD)] = r["doc_id"]
            assert ids[name] == Counter(last.values())
        elif name == "simhash":
            assert ids[name] == Counter({g for _, g in plain_groups([(r["doc_id"], r["text"]) for r in rows])})
        elif name == "mixing":
            rated = production.mixture(spark, before, SMALL).rated().collect()
            assert ids[name] == Counter({r["doc_id"]: r["copies"] for r in rated if r["copies"]})
        else:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(production.BYTE_BPE, "rb"))}
            enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
            assert Counter((r["doc_id"], tuple(r["ids"])) for r in docs.collect()) == Counter(
                (r["doc_id"], tuple(enc.encode_ordinary(r["text"] or ""))) for r in rows)


def test_registry():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {f"{x.split('_')[0]}_" for x in names if x.startswith("op")}
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "simhash", "mixing", "byte_bpe"]
