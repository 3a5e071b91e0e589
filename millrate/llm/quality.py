"""Quality rules with compression bands (operator 6).

Base rules count words, symbols, repeated lines and repeated five-word
windows.  The method's verdict compares zstandard ratios (compressed bytes to
bytes) with limits that depend on the length: short texts compress badly in
any language, long ones well.  The whole text must lie in the band of its
length, every whole chunk of :data:`CHUNK` bytes in the band of chunks, and
every piece in the band of its size: below is repetitive, above is
incompressible.  Pieces of 256, 512 or 1,024 bytes (by the text's length) start
every half piece and the last ends where the text ends, so each byte of a text
of 256 bytes or more lies in a piece, with or without whole chunks.

Defined results: a NULL or blank text has zero counts, no ratio, and fails
the base rules; repeated rows are judged each; an empty table gives no rows;
other columns take no part.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from math import inf, log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from millrate.llm.common import pieces

LEVEL = 3
CHUNK = 4096
#: From so many bytes on, the whole text's ratio must lie between these.  The upper
#: limit falls evenly with the logarithm of the length from one band's start to the
#: next, between prose of sf0.1 and base64 words of the same length; there is none
#: under 128 bytes, where zstandard can't tell them apart.
BANDS = ((0, 0.0, inf), (64, 0.45, inf), (128, 0.40, 0.99), (160, 0.40, 0.955), (192, 0.40, 0.925),
         (256, 0.36, 0.89), (384, 0.36, 0.835), (512, 0.32, 0.79), (768, 0.32, 0.755), (1024, 0.28, 0.735),
         (2048, 0.28, 0.715), (4096, 0.24, 0.70), (16384, 0.20, 0.65))
CHUNK_BAND = (0.15, 0.70)
#: From so many bytes on, a text has pieces of a size, whose ratios lie between
#: these.  Prose of sf0.1: 0.57-0.84, 0.50-0.73, 0.44-0.61; base64 words from
#: 0.91, 0.82, 0.77 on; a repeated phrase at most 0.2.
PIECES = ((256, 256, 0.33, 0.89), (1024, 512, 0.29, 0.79), (4096, 1024, 0.25, 0.735))
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeat_words(words: Sequence[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    if len(number) == len(words):
        return 0
    code = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        code = (code ^ ids[k:k + n].astype(np.uint64) + np.uint64(1)) * _MIX
        code ^= code >> np.uint64(29)
    ordered = np.sort(code)
    if not (ordered[1:] == ordered[:-1]).any():  # equal windows have equal codes
        return 0
    exact = ids[:n]
    for k in range(1, window):  # number the windows word by word, without hashing
        _, exact = np.unique(exact * len(number) + ids[k:k + n], return_inverse=True)
    again = np.bincount(exact)[exact] > 1
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[:n] += again
    edge[window:] -= again
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(words), len(text) - (len(raw) - len(raw.translate(None, _SPACE))),
            len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)),
            repeat_words(words))


class Bands:
    """Compression ratios and the verdict on them."""

    def __init__(self, bands=BANDS, chunk_band=CHUNK_BAND, chunk: int = CHUNK, level: int = LEVEL,
                 pieces=PIECES) -> None:
        self.bands, self.chunk_band, self.chunk, self.pieces = bands, chunk_band, chunk, pieces
        self.pack = zstandard.ZstdCompressor(level=level)
        self.starts = [b[0] for b in bands]
        self.piece_starts = [p[0] for p in pieces]

    def ratios(self, raw: bytes) -> tuple[float | None, float | None, float | None]:
        """Of the whole text, and the lowest and highest of its whole chunks."""
        if not raw:
            return None, None, None
        size = self.chunk
        each = [len(self.pack.compress(raw[k:k + size])) / size for k in range(0, len(raw) - size + 1, size)]
        return len(self.pack.compress(raw)) / len(raw), min(each, default=None), max(each, default=None)

    def piece_ratios(self, raw: bytes) -> tuple[float | None, float | None]:
        """The lowest and highest of the text's pieces, which cover all of it."""
        at = bisect_right(self.piece_starts, len(raw)) - 1
        if at < 0:
            return None, None
        size = self.pieces[at][1]
        last = len(raw) - size
        each = [len(self.pack.compress(raw[k:k + size])) / size for k in (*range(0, last, size // 2), last)]
        return min(each), max(each)

    def limits(self, n: int) -> tuple[float, float]:
        """Of the ratio of a whole text of ``n`` bytes."""
        at = bisect_right(self.starts, n) - 1
        start, least, most = self.bands[at]
        if most < inf and at + 1 < len(self.bands):
            end, _, then = self.bands[at + 1]
            most += (then - most) * log(n / start) / log(end / start)
        return least, most

    def verdict(self, n: int, whole: float | None, low: float | None, high: float | None,
                piece_low: float | None = None, piece_high: float | None = None) -> str:
        """'ok', 'repetitive' or 'incompressible'."""
        if whole is None:
            return "ok"
        least, most = self.limits(n)
        piece_least, piece_most = self.pieces[bisect_right(self.piece_starts, n) - 1][2:]
        if (whole < least or low is not None and low < self.chunk_band[0]
                or piece_low is not None and piece_low < piece_least):
            return "repetitive"
        if (whole > most or high is not None and high > self.chunk_band[1]
                or piece_high is not None and piece_high > piece_most):
            return "incompressible"
        return "ok"


_SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
           "n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunk_low double, "
           "chunk_high double, verdict string, piece_low double, piece_high double")


def judge(docs: DataFrame, bands=BANDS, chunk_band=CHUNK_BAND, chunk: int = CHUNK,
          min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, cuts=PIECES) -> DataFrame:
    """One row per document: base counts, base_failed, ratios, verdict, kept, piece ratios."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = Bands(bands, chunk_band, chunk, pieces=cuts)
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 3 + [pa.string()] + [pa.float64()] * 2
        for batch in pieces(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                counts = base_counts(text)
                failed = counts[0] < min_words or 100 * counts[4] > max_repeat_percent * counts[0]
                raw = text.encode()
                ratios, parts = rule.ratios(raw), rule.piece_ratios(raw)
                said = rule.verdict(len(raw), *ratios, *parts)
                rows.append((*counts, failed, not failed and said == "ok", *ratios, said, *parts))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds[1:]))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)
