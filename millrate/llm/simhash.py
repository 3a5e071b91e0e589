"""SimHash near-dedup by Golay-code fuzzy hashing (operator 3).

A fingerprint has 64 bits.  Two that differ in at most three bits agree on one
of four 16-bit blocks, and of the two 23-bit segments cut from the other 48
bits one has at most one differing bit.  The binary Golay code of length 23 is
perfect with radius 3: every segment has one nearest codeword.  A segment one
bit away has the same nearest codeword or one at distance 4, so with

* index keys: (block, its value, index of the segment's nearest codeword) and
* query keys: the same with every codeword within distance 4 (one or six),

any such pair meets in the join for some block and segment.  Joined pairs are
verified by their differing bits.  Equal fingerprints are one node from the
start, so groups of exact copies make no pairs.  The links' connected
components come from alternating star contractions, each step written to the
shared folder; no pair, link or component reaches the driver.

Defined results: a NULL or blank text has fingerprint zero; NULL ids have no
part in a component's smallest id (a component of NULL ids only has none);
repeated rows are reported each; an empty table gives no rows; other columns
take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrate.llm.common import free_name, one_each, pieces, stored, text_or_empty
from millrate.session import remove_path

SHINGLE = 3
MAX_BITS = 3
#: Golay generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
_SLAB = 1 << 15


# --- fingerprints -------------------------------------------------------------
def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, _SLAB):
        part = words[start:start + _SLAB + shingle - 1]
        shifted = zip(*(part[k:] for k in range(shingle))) if n > 1 or len(words) == shingle else [words]
        h = np.array([digest(b" ".join(x), 42) for x in shifted], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fp = np.array([fingerprint(x or "", shingle) for x in batch.column("text").to_pylist()],
                          dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(fp)],
                names=["doc_id", "text_hash", "fp"])

    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


# --- Golay keys ---------------------------------------------------------------
def _syndromes(words: np.ndarray) -> np.ndarray:
    out = words.copy()
    for bit in range(22, 10, -1):
        out ^= np.where(out >> bit & 1, GENERATOR << (bit - 11), 0)
    return out


def _errors(radius: int) -> np.ndarray:
    """For each syndrome the error patterns of at most ``radius`` bits, the
    lightest first, filled up with -1."""
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(radius + 1):
        pattern = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)])
        for syndrome, error in zip(_syndromes(pattern).tolist(), pattern.tolist()):
            found[syndrome].append(error)
    widest = max(map(len, found))
    return np.array([x + [-1] * (widest - len(x)) for x in found])


_NEAREST, _NEAR = _errors(3), _errors(4)


def _codewords(segment: np.ndarray, errors: np.ndarray) -> np.ndarray:
    """(n, k) indices of codewords near each segment; -1: none."""
    error = errors[_syndromes(segment)]
    return np.where(error < 0, -1, (segment[:, None] ^ error) >> 11)


def golay_keys(fp: np.ndarray, near: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for all blocks and segments; near: query keys."""
    rows, keys = [], []
    u = fp.view(np.uint64)
    block = [(u >> np.uint64(16 * b) & np.uint64(0xFFFF)).astype(np.int64) for b in range(4)]
    for b in range(4):
        x, y, z = (block[k] for k in range(4) if k != b)
        rest = x | y << 16 | z << 32
        for s in range(2):
            words = _codewords(rest >> (23 * s) & 0x7FFFFF, _NEAR if near else _NEAREST)
            i, k = np.nonzero(words >= 0)
            rows.append(i)
            keys.append(((b << 1 | s) << 16 | block[b][i]) << 12 | words[i, k])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(nodes: DataFrame, near: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            row, key = golay_keys(fp, near)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], names=["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key long, fp long")


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v), u < v: distinct fingerprints that differ in at most
    ``max_bits`` (3 or fewer) bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the keys find pairs of up to 3 differing bits")
    # Spark sizes the keys as if each fingerprint had one, and would broadcast them.
    index, query = _keyed(nodes, False).alias("i"), _keyed(nodes, True).alias("q")
    close = F.bit_count(F.col("q.fp").bitwiseXOR(F.col("i.fp"))) <= max_bits
    return index.hint("merge").join(query, (F.col("q.key") == F.col("i.key")) & (F.col("q.fp") < F.col("i.fp")) & close
                      ).select(F.col("q.fp").alias("u"), F.col("i.fp").alias("v")).distinct()


# --- components ---------------------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) but the roots: the
    smallest node of its component.  Alternates the large-star and small-star
    steps until the links stay the same."""
    spark = edges.sparkSession

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links")
    before, at = None, state(now)
    while at != before:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").filter("v > u").select(
            F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = stored(small.distinct(), "links")
        for path in {f.rsplit("/", 1)[0] for f in now.inputFiles()}:
            remove_path(spark, path)
        now, before = after, at
        at = state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest id of its
    component), root (the component's smallest fingerprint), text_hash."""
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    tree = components(links(nodes, max_bits))
    rooted = nodes.join(tree.hint("merge"), nodes["fp"] == tree["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = rooted.select("fp", "root").join(least, "root")
    return prints.join(labelled, "fp").select("doc_id", "fp", "component_id", "root", "text_hash")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the smallest id, once."""
    first = near_groups(docs, shingle, max_bits).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    same = first.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    one = same.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("w")).select("w.*")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    names = [free_name(docs.columns, "__id"), free_name(docs.columns, "__hash")]
    kept = one.select(key.alias(names[0]), F.col("text_hash").alias(names[1]), "n")
    named = docs.withColumns({names[0]: key, names[1]: F.xxhash64(text_or_empty())})
    return one_each(named, kept, names).select(*docs.columns)
