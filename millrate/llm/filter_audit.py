"""Filter interaction audit by sorted posting lists (operator 13).

Each filter has, per part and range of document ids, the sorted list of the
documents that fail it.  A range is what one Arrow batch holds of a part after
the table is range-partitioned and sorted by (part, id), so a part with a third
of all rows is spread over many tasks.  Within a range, postings are places in
id order, which keeps rows that share an id (or have none) apart.  Unions of
filters grow by galloping merges of the sorted lists; what a filter removes
after a set of others is the galloping difference of its list and their union,
and the good and toxic ones among them its intersection with the lists of
labelled documents.  Ranges don't overlap, so their sizes are summed.

A filter removes the same documents after a set of others in whatever order
these ran, so the five filters' 120 orders need 5 x 16 differences; each
(part, order, step) reads its own from the sums.

Defined results: a NULL text is empty, a NULL part the empty string; NULL
numbers and unknown documents in ``labels`` take no part, and of repeated labels
one with 1 suffices; repeated rows count each; a row without an id counts as
having a larger id than any other (for the repeat filter); whole texts are
judged, however long; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrate.llm.common import pieces, stored
from millrate.operators.util import range_partitions

FILTERS = "ABCDE"
#: Limits of the filters A, B, C; the characters of D.
MIN_WORDS, MIN_DISTINCT_PCT, MAX_CAPITAL_PCT = 100, 80, 10
SYMBOLS = b"#$%&*|"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Entries that gallop on from one that is searched for.
_STRIDE = 4
#: Sums that a task holds before it hands them on, in parts.
_PARTS = 2_000


# --- galloping merges of sorted lists ---------------------------------------------
def _places(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """First place in ``long`` of a value not below each entry of ``short``.

    Galloping, for many entries side by side: every :data:`_STRIDE`-th entry is
    searched for; the entries after it start from its place, each from the one
    before, with steps that double until they pass it, and a binary search
    within the last step."""
    at = np.empty(len(short), dtype=np.int64)
    at[::_STRIDE] = np.searchsorted(long, short[::_STRIDE])
    for k in range(1, min(_STRIDE, len(short))):
        want = short[k::_STRIDE]
        low = at[k - 1::_STRIDE][:len(want)].copy()
        step = np.ones(len(want), dtype=np.int64)
        on = np.arange(len(want))
        while len(on):  # all before ``low`` is smaller
            ahead = low[on] + step[on] - 1
            on = on[(ahead < len(long)) & (long[np.minimum(ahead, len(long) - 1)] < want[on])]
            low[on] += step[on]
            step[on] *= 2
        high = np.minimum(low + step - 1, len(long))
        while (open_ := low < high).any():
            mid = (low + high) // 2
            less = open_ & (long[np.minimum(mid, len(long) - 1)] < want)
            low = np.where(less, mid + 1, low)
            high = np.where(open_ & ~less, mid, high)
        at[k::_STRIDE] = low
    return at


def _member(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which entries of ``a`` are in ``b``; the shorter list gallops through the longer."""
    if not len(a) or not len(b):
        return np.zeros(len(a), dtype=bool)
    if len(a) <= len(b):
        at = _places(a, b)
        return b[np.minimum(at, len(b) - 1)] == a
    found = np.zeros(len(a), dtype=bool)
    at = np.minimum(_places(b, a), len(a) - 1)
    found[at[a[at] == b]] = True
    return found


def intersect(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[_member(a, b)]


def subtract(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[~_member(a, b)]


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sorted union: what only the shorter list has is inserted into the longer."""
    if len(a) < len(b):
        a, b = b, a
    new = subtract(b, a)
    return np.insert(a, _places(new, a), new) if len(new) else a


def differences(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """[filter, set of earlier filters] -> (union of the earlier ones, removed,
    good and toxic ones among the removed); sets as bit masks, zero where the
    filter is in the set."""
    k = len(lists)
    unions = [np.empty(0, np.int64)] * (1 << k)
    for mask in range(1, 1 << k):
        low = mask & -mask
        unions[mask] = union(unions[mask ^ low], lists[low.bit_length() - 1])
    out = np.zeros((k, 1 << k, 4), dtype=np.int64)
    for f in range(k):
        for mask in range(1 << k):
            if not mask >> f & 1:
                removed = subtract(lists[f], unions[mask])
                out[f, mask] = (len(unions[mask]), len(removed), len(intersect(good, removed)),
                                len(intersect(toxic, removed)))
    return out


# --- failures of each document ------------------------------------------------------
def failures(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    raw = text.encode()
    words = raw.split()  # of bytes: ASCII white space only
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return (len(words) < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT_PCT * len(words)) << 1 | (
        100 * capitals > MAX_CAPITAL_PCT * len(text)) << 2 | (symbols > 0) << 3


def failing(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, bits: one row per document, bit i for filter i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("part"),
                pa.array([failures(t) for t in texts], pa.int32()),
                pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())],
                names=["doc_id", "part", "bits", "digest"])

    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    own = stored(rows.mapInArrow(run, "doc_id long, part string, bits int, digest binary"), "filter-bits")
    first = own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter(
        "n > 1 and first is not null").select(F.col("digest").alias("same"), "first")
    repeat = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    return own.join(first, own["digest"] == first["same"], "left").select(
        "doc_id", "part", (F.col("bits") + F.when(repeat, 16).otherwise(0)).alias("bits"))


def _sums(rows: DataFrame) -> DataFrame:
    """part, filter, before, n, and the four sums of :func:`differences`, added
    up over the ranges of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int, np.ndarray]] = {}

        def hand_on() -> pa.RecordBatch:
            cell = [(f, m) for f in range(len(FILTERS)) for m in range(1 << len(FILTERS)) if not m >> f & 1]
            fs, ms = (np.array(x) for x in zip(*cell))
            got = np.concatenate([s[fs, ms] for _, s in held.values()])
            names = [p for p in held for _ in cell]
            sizes = np.repeat([n for n, _ in held.values()], len(cell))
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(np.tile(fs, len(held)), pa.int32()),
                 pa.array(np.tile(ms, len(held)), pa.int32()), pa.array(sizes, pa.int64()),
                 *(pa.array(got[:, k], pa.int64()) for k in range(4))],
                names=["part", "filter", "before", "n", "earlier", "removed", "good", "toxic"])

        for batch in batches:
            part = batch.column("part").dictionary_encode()
            code = part.indices.to_numpy(zero_copy_only=False)
            bits, label = batch.column("bits").to_numpy(), batch.column("label").to_numpy()
            for k, name in enumerate(part.dictionary.to_pylist()):
                mine = code == k  # one range of the part, in id order
                b, lab = bits[mine], label[mine]
                got = differences([np.flatnonzero(b >> f & 1) for f in range(len(FILTERS))],
                                  np.flatnonzero(lab & 1), np.flatnonzero(lab & 2))
                n, s = held.get(name, (0, 0))
                held[name] = (n + len(b), s + got)
            if len(held) >= _PARTS:
                yield hand_on()
                held.clear()
        if held:
            yield hand_on()

    cells = rows.mapInArrow(run, "part string, filter int, before int, n long, earlier long, removed long, "
                                 "good long, toxic long")
    return cells.groupBy("part", "filter", "before").agg(
        *[F.sum(c).alias(c) for c in ("n", "earlier", "removed", "good", "toxic")])


def steps(spark) -> DataFrame:
    """filter_order, step, filter, before: the 600 steps of all orders."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(FILTERS[x] for x in order), step, f, before))
            before |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, before int")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, order and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.

    ``labels``: doc_id, quality, toxic.
    """
    marked = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.bit_or(
        F.when(F.col("quality") == 1, 1).otherwise(0).bitwiseOR(
            F.when(F.col("toxic") == 1, 2).otherwise(0))).alias("label")).filter("label > 0").select(
        F.col("doc_id").alias("marked_id"), "label")
    rows = failing(docs, part)
    rows = stored(rows.join(marked, F.col("doc_id") == F.col("marked_id"), "left").select(
        "doc_id", "part", "bits", F.coalesce("label", F.lit(0)).alias("label"),
        F.monotonically_increasing_id().alias("at")), "filter-rows")
    keys = ["part", "doc_id", "at"]  # at: rows that share an id can be dealt apart
    ranged = rows.repartitionByRange(range_partitions(rows), *keys).sortWithinPartitions(*keys)
    sums = stored(_sums(ranged), "filter-sums")  # 80 rows per part

    last = (1 << len(FILTERS)) - 1
    alone = sums.filter(F.col("before") == 0).select(
        "part", "filter", F.col("removed").alias("fails"))
    unique = sums.filter(F.col("before") == F.expr(f"{last} - shiftleft(1, filter)")).select(
        "part", "filter", F.col("removed").alias("unique_fails"))
    # A filter comes after the set S in |S|! (4 - |S|)! of the orders.
    orders = F.element_at(F.array(*map(F.lit, (24, 6, 4, 6, 24))), F.bit_count("before") + 1)
    shapley = sums.groupBy("part", "filter").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    each = alone.join(unique, ["part", "filter"]).join(shapley, ["part", "filter"])
    return sums.join(F.broadcast(steps(docs.sparkSession)), ["filter", "before"]).join(
        each, ["part", "filter"]).select(
        "part", "filter_order", "step",
        (F.col("n") - F.col("earlier") - F.col("removed")).alias("kept"), "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails",
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")
