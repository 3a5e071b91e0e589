"""Byte-level BPE encoding and decoding (operator 2).

A piece (one match of the split pattern) is merged with a segment tree over
its byte positions.  A leaf holds ``rank * width + position`` of the pair that
starts there, so the root is the leftmost minimum rank.  A merge changes three
leaves (the merged position, its dead right neighbour and its live left
neighbour), each a point update of logarithmic cost.  Pieces of up to
:data:`WIDE` bytes go through many trees at once in numpy; a longer one through
a tree of its own, in O(n log n).

Workers keep bounded tables of pieces seen; a text whose white space is single
spaces and line ends is cut at the spaces, as no match crosses a space to the
left of a word.

Defined results: a NULL or empty text has no ids and decodes to no bytes; NULL
and repeated ids pass as they are; a very long text is encoded whole, in a batch of
its own; an empty table gives no rows; other columns of the table take no part.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millrate.llm.common import pieces

#: Longest piece, in bytes, that shares a numpy pass with others.
WIDE = 64
#: Entries of a worker's tables of pieces (up to WIDE bytes each) and of what stands
#: between spaces (up to WIDE characters); longer ones are never kept, so entries
#: bound the bytes.  A full table starts anew.
KNOWN, SPACED = 200_000, 300_000
#: Bytes of text encoded at once.
BATCH_BYTES = 2 << 20
_NONE = np.int64(1) << 60
_ODD = re.compile(r"[^\S \n]")


class Tree:
    """Leftmost minimum over positions, with point updates."""

    def __init__(self, leaves: list[int]) -> None:
        self.width = 1 << max(0, len(leaves) - 1).bit_length()
        none = int(_NONE)
        self.node = [none] * self.width + leaves + [none] * (self.width - len(leaves))
        for k in range(self.width - 1, 0, -1):
            self.node[k] = min(self.node[2 * k], self.node[2 * k + 1])

    def put(self, at: int, value: int) -> None:
        node, k = self.node, at + self.width
        node[k] = value
        while k > 1:
            k >>= 1
            low = min(node[2 * k], node[2 * k + 1])
            if node[k] == low:
                return
            node[k] = low


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.decimal = [b"%d" % i for i in range(len(self.bytes_of))]
        self.base = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        get = self.ranks.get
        self.pair = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = get(token[:cut]), get(token[cut:])
                if a is not None and b is not None:
                    self.pair[a << 20 | b] = rank
        self.pair_keys = np.array(sorted(self.pair), dtype=np.int64)
        self.pair_rank = np.array([self.pair[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        self.known: dict[str, bytes] = {}     # a piece's ids, little-endian uint32
        self.spaced: dict[str, bytes] = {}    # the same for " " + what stands between spaces

    # -- merging ---------------------------------------------------------------
    def _merge_long(self, piece: bytes) -> list[int]:
        ids: list[int] = self.base[np.frombuffer(piece, np.uint8)].tolist()
        n, pair, none = len(ids), self.pair, int(_NONE)
        width = 1 << (n - 1).bit_length()

        def leaf(i: int, j: int) -> int:
            rank = pair.get(ids[i] << 20 | ids[j])
            return none if rank is None else rank * width + i

        tree = Tree([leaf(i, i + 1) for i in range(n - 1)] + [none])
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while (low := tree.node[1]) < none:
            i = low % width
            j, ids[i] = right[i], low // width
            after = right[i] = right[j]
            ids[j] = -1
            tree.put(j, none)
            if after < n:
                left[after] = i
                tree.put(i, leaf(i, after))
            else:
                tree.put(i, none)
            if left[i] >= 0:
                tree.put(left[i], leaf(left[i], i))
        return [x for x in ids if x >= 0]

    def _leaves(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        key = a << 20 | b
        k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = (self.pair_keys[k] == key) & (a >= 0) & (b >= 0)
        return np.where(found, self.pair_rank[k] * width + at, _NONE)

    def _merge_many(self, batch: list[bytes], width: int) -> list[bytes]:
        n = len(batch)
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in batch), np.uint8).reshape(n, width)
        size = np.array([len(x) for x in batch])
        ids = np.full((n, width + 1), -1, dtype=np.int64)  # the last column: no neighbour
        ids[:, :width] = np.where(np.arange(width) < size[:, None], self.base[raw], -1)
        places = np.arange(width + 1)
        right = np.where(places + 1 < size[:, None], places + 1, width)
        left = np.tile(np.concatenate([[width], np.arange(width)]), (n, 1))
        tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
        tree[:, width:2 * width - 1] = self._leaves(
            ids[:, :width - 1], ids[:, 1:width], np.arange(width - 1)[None, :], width)
        at = width
        while at > 1:
            tree[:, at // 2:at] = np.minimum(tree[:, at:2 * at:2], tree[:, at + 1:2 * at:2])
            at //= 2
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            low = tree[rows, 1]
            i = low % width
            j = right[rows, i]
            ids[rows, i] = low // width
            ids[rows, j] = -1
            after = right[rows, j]
            right[rows, i] = after
            left[rows, after] = i
            before = left[rows, i]
            mine = ids[rows, i]
            for pos, value in (
                    (j, np.full(len(rows), _NONE)),
                    (i, self._leaves(mine, ids[rows, after], i, width)),
                    (before, self._leaves(ids[rows, before], mine, before, width))):
                own = pos < width
                r, k = rows[own], pos[own] + width
                tree[r, k] = value[own]
                for _ in range(width.bit_length() - 1):
                    k >>= 1
                    tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])
            rows = rows[tree[rows, 1] < _NONE]
        live = ids[:, :width] >= 0
        flat = ids[:, :width][live].astype("<u4").tobytes()
        ends = (np.cumsum(live.sum(axis=1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, wanted: Iterable[str]) -> dict[str, bytes]:
        """Put the ids of pieces into ``known``; those of long pieces are returned."""
        long: dict[str, bytes] = {}
        by_width: dict[int, list[str]] = {}
        for piece in wanted:
            raw = piece.encode()
            rank = self.ranks.get(raw)
            if rank is not None and len(raw) <= WIDE:
                self.known[piece] = rank.to_bytes(4, "little")
            elif len(raw) > WIDE:
                long[piece] = rank.to_bytes(4, "little") if rank is not None else np.array(
                    self._merge_long(raw), dtype="<u4").tobytes()
            else:
                by_width.setdefault(max(8, 1 << (len(raw) - 1).bit_length()), []).append(piece)
        for width, group in by_width.items():
            for k in range(0, len(group), 8192):
                part = group[k:k + 8192]
                self.known.update(zip(part, self._merge_many([x.encode() for x in part], width)))
        return long

    # -- texts -----------------------------------------------------------------
    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian uint32."""
        if len(self.known) > KNOWN:
            self.known.clear()
        if len(self.spaced) > SPACED:
            self.spaced.clear()
        plain = [not ("  " in t or " \n" in t or "\n " in t or _ODD.search(t)) for t in texts]
        cut = [t.split(" ") if p else self.split(t) for t, p in zip(texts, plain)]
        heads = {x[0]: self.split(x[0]) for x, p in zip(cut, plain) if p}
        new = {k: self.split(" " + k)
               for k in set().union(*(x[1:] for x, p in zip(cut, plain) if p)) - self.spaced.keys()}
        wanted = {y for x, p in zip(cut, plain) if not p for y in x}
        wanted.update(*heads.values(), *new.values())
        long, table, join = self.learn(wanted - self.known.keys()), self.known, b"".join
        known = (lambda x: long[x] if x in long else table[x]) if long else table.__getitem__
        own: dict[str, bytes] = {}  # of this batch only
        for k, x in new.items():
            (self.spaced if len(k) <= WIDE else own)[k] = join(map(known, x))
        kept = self.spaced
        spaced = (lambda x: own[x] if x in own else kept[x]) if own else kept.__getitem__
        return [join(map(known, heads[x[0]])) + join(map(spaced, x[1:])) if p else join(map(known, x))
                for x, p in zip(cut, plain)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One for each Python worker and file."""
    return Codec(path, pattern)


def _texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in pieces(batches, max_bytes=BATCH_BYTES):
            ids = [np.frombuffer(x, "<u4") for x in coder.encode(_texts(batch))]
            ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.uint32), *ids]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded (the bytes that the ids of each row stand for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            out = [coder.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids in decimal, joined by a
    space), decoded_sha256 (of the bytes decoded from the ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        decimal = coder.decimal.__getitem__
        for batch in pieces(batches, max_bytes=BATCH_BYTES):
            count, ids_sha, decoded_sha = [], [], []
            for raw in coder.encode(_texts(batch)):
                ids = np.frombuffer(raw, "<u4").tolist()
                count.append(len(ids))
                ids_sha.append(hashlib.sha256(b" ".join(map(decimal, ids))).hexdigest())
                decoded_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()),
                 pa.array(decoded_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
