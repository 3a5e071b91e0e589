"""Token-ID files with frequency-ranked variable-length ids (operator 1).

1. Texts are encoded with the tokenizers library; the ids of all documents are
   stored in ascending doc_id order, range-partitioned by id.
2. Ids are counted over the whole corpus and ranked, the most frequent first.
3. Ranks are written in a byte-aligned variable-length code with separate
   control bytes: a rank takes one to four little-endian bytes, and control
   bytes hold four two-bit lengths each.  Frequent ids take one byte.
4. Readers decode with numpy: a table gives the lengths of each control byte's
   four ranks, their running sum the places of the data bytes, and the ranking
   gives the ids back.

File format: a Parquet folder with one row per block (shard, block, offset,
n_docs, n_tokens, payload); ascending (shard, block) is ascending doc_id, and
offset counts the ids of the shard before the block. Spark's writer commits whole
files, so lost executors leave nothing behind.  A payload is four little-endian uint32 (magic, documents,
tokens, bytes of data), the documents' ids (int64), a byte each that is 1 for a
missing id, their token counts (uint32), the control bytes, the data bytes.  The
ranking is a table of its own (rank, id) and has at most one row per id.

Defined results: a NULL or empty text has the end id alone; NULL ids come
first; rows of equal id stay next to each other, ordered by a hash of their
text; an empty table gives no blocks; other columns take no part.
"""

from __future__ import annotations

import functools
import string
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrate.llm import word_bpe
from millrate.llm.common import pieces, text_or_empty
from millrate.session import remove_path, scratch_path

END_ID = 1
MAGIC = 0x314B4F54
#: Tokens after which a block ends (a longer document makes a longer block).
BLOCK_TOKENS = 1 << 19
#: Entries of a worker's table of words, and their longest word in characters (longer
#: ones are merged again in each batch), which bound its bytes; a full table starts anew.
WORDS, LONGEST = 400_000, 64


# --- the code -----------------------------------------------------------------
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.int64)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of non-negative 32-bit ranks."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    code[:len(ranks)] = size - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1).astype(np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks again, by table lookup."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    start = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[start].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= raw[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


# --- encoding -----------------------------------------------------------------
class Encoder:
    """The library's ids of whole texts.

    A text's words are found here and each different word is merged by the
    library's model once; a text with a special string, a control character
    that Python takes for white space, or a character that Python's tables don't
    know (the library's may) goes through the library as it is.
    """

    def __init__(self, path: str) -> None:
        spec = word_bpe.check(path)
        self.library = Tokenizer.from_file(path)
        self.merge = self.library.model.tokenize
        self.special = word_bpe.specials(spec).search
        self.split = regex.compile(word_bpe.SPLIT).findall
        self.letter = word_bpe.byte_letters()
        self.known: dict[str, bytes] = {}   # of words, and of the pieces of words

    def _piece(self, piece: str) -> bytes:
        packed = self.known.get(piece)
        if packed is None:
            letters = piece if piece.isascii() and piece.isprintable() else "".join([self.letter[b] for b in piece.encode()])
            ids = [t.id for t in self.merge(letters)]
            packed = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= LONGEST:
                self.known[piece] = packed
        return packed

    def _word(self, word: str) -> bytes:
        if word.isascii():
            letters = word.rstrip(string.punctuation)
            if letters.isalpha():  # what follows letters is one run of other characters
                end = word[len(letters):]
                return self._piece(letters) + self._piece(end) if end else self._piece(word)
        return b"".join(map(self._piece, self.split(word)))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > WORDS:
            self.known.clear()
        whole = [bool(self.special(t) or word_bpe.KEPT_CONTROLS.search(t)
                      or not t.isascii() and word_bpe.has_unassigned(t)) for t in texts]
        cut = [[] if w else word_bpe.normalise(t).split() for t, w in zip(texts, whole)]
        long: dict[str, bytes] = {}  # of this batch only
        for word in set().union(*cut) - self.known.keys():
            (self.known if len(word) <= LONGEST else long)[word] = self._word(word)
        known = self.known
        get = (lambda w: long[w] if w in long else known[w]) if long else known.__getitem__
        return [np.array(self.library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() if w
                else b"".join(map(get, x)) for t, x, w in zip(texts, cut, whole)]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


_BLOCK = ("shard int, block int, offset long, n_docs int, n_tokens long, "
          "ids binary, missing binary, counts binary, tokens binary")


def token_blocks(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Blocks of encoded documents (little-endian ids with the end id), cut from
    range partitions in ascending order of doc_id.  ``shard`` is the partition,
    ``offset`` the ids of the shard before the block."""
    rows = docs.select("doc_id", text_or_empty().alias("text"), F.xxhash64("text").alias("tie"))
    order = (F.asc_nulls_first("doc_id"), F.asc("tie"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = encoder(path), TaskContext.get().partitionId()
        number, offset, ids, texts, size = 0, 0, [], [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "block": number, "offset": offset, "n_docs": len(ids), "n_tokens": size // 4,
                "ids": np.array([x or 0 for x in ids], dtype="<i8").tobytes(),
                "missing": np.array([x is None for x in ids], dtype=np.uint8).tobytes(),
                "counts": np.array([len(x) // 4 for x in texts], dtype="<u4").tobytes(),
                "tokens": b"".join(texts)}], schema=schema)

        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("offset", pa.int64()),
                            ("n_docs", pa.int32()), ("n_tokens", pa.int64()),
                            *((c, pa.binary()) for c in ("ids", "missing", "counts", "tokens"))])
        for batch in pieces(batches):
            for doc, raw in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text").to_pylist())):
                ids.append(doc)
                texts.append(raw + end)
                size += len(raw) + 4
                if size >= 4 * BLOCK_TOKENS:
                    yield made()
                    number, offset, ids, texts, size = number + 1, offset + size // 4, [], [], 0
        if ids:
            yield made()

    return ordered.select("doc_id", "text").mapInArrow(run, _BLOCK)


# --- files --------------------------------------------------------------------
def ranking(blocks: DataFrame) -> np.ndarray:
    """The ids by falling frequency (ties: the smaller id first); as long as the
    vocabulary at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, dtype=np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), "<u4")
            here = np.bincount(ids, minlength=len(seen))
            here[:len(seen)] += seen
            seen = here
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["id", "n"])

    counted = blocks.select("tokens").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = counted.toPandas()  # one row per id of the vocabulary
    return found.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(dtype=np.uint32)


_HEAD = "<4I"


def write(blocks: DataFrame, path: str, id_of_rank: np.ndarray) -> None:
    """The files of token blocks."""
    rank_of = np.zeros(int(id_of_rank.max(initial=0)) + 1, dtype=np.uint32)
    rank_of[id_of_rank] = np.arange(len(id_of_rank), dtype=np.uint32)
    sent = blocks.sparkSession.sparkContext.broadcast(rank_of)  # one number per id of the vocabulary
    names = ("shard", "block", "offset", "n_docs", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1) for k in range(batch.num_rows)):
                docs, missing, counts, raw = (row.column(c)[0].as_py() for c in ("ids", "missing", "counts", "tokens"))
                control, data = pack(sent.value[np.frombuffer(raw, "<u4")])
                head = struct.pack(_HEAD, MAGIC, len(missing), len(raw) // 4, len(data))
                yield pa.RecordBatch.from_arrays(
                    [*(row.column(c) for c in names),
                     pa.array([head + docs + missing + counts + control + data], pa.binary())],
                    names=[*names, "payload"])

    schema = "shard int, block int, offset long, n_docs int, n_tokens long, payload binary"
    blocks.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def read_block(payload: bytes, id_of_rank: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, token counts, all token ids) of a block."""
    magic, docs, tokens, size = struct.unpack_from(_HEAD, payload)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = struct.calcsize(_HEAD)
    ids = np.frombuffer(payload, "<i8", docs, at)
    missing = np.frombuffer(payload, np.uint8, docs, at + 8 * docs)
    counts = np.frombuffer(payload, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    control = payload[at:at + -(-tokens // 4)]
    at += len(control)
    flat = id_of_rank[unpack(control, payload[at:at + size], tokens)]
    return [None if m else i for i, m in zip(ids.tolist(), missing.tolist())], counts, flat


def read(spark: SparkSession, path: str, id_of_rank: np.ndarray) -> DataFrame:
    """doc_id, start (ids of all documents before), tokens, read from files."""
    blocks = spark.read.parquet(path)
    sent = spark.sparkContext.broadcast(id_of_rank)  # one number per id of the vocabulary
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, payload in zip(batch.column("first").to_pylist(), batch.column("payload")):
                ids, counts, flat = read_block(payload.as_py(), sent.value)
                ends = np.cumsum(counts.astype(np.int64))
                raw, cut = flat.astype("<u4").tobytes(), (4 * np.concatenate([[0], ends])).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(first + ends - counts),
                     pa.array([raw[a:b] for a, b in zip(cut, cut[1:])], pa.binary())],
                    names=["doc_id", "start", "tokens"])

    # A row per shard, that is, per task that wrote: bounded by the partitions.
    placed = blocks.join(F.broadcast(shards), "shard").select(
        (F.col("offset") + F.col("before")).alias("first"), "payload")
    return placed.mapInArrow(run, "doc_id long, start long, tokens binary")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows of :func:`read`."""
    return rows.select("doc_id", "start", (F.length("tokens") / 4).cast("long").alias("n_tokens"),
                       F.crc32("tokens").alias("ids_crc32"))


def encode_to_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> np.ndarray:
    """Write all documents to ``path``; returns the ranking (the ids in order)."""
    spark = docs.sparkSession
    kept = scratch_path(spark, "token-blocks")
    token_blocks(docs, vocabulary, end_id).write.option("compression", "zstd").parquet(kept)
    blocks = spark.read.schema(_BLOCK).parquet(kept)
    id_of_rank = ranking(blocks)
    write(blocks, path, id_of_rank)
    remove_path(spark, kept)
    return id_of_rank
