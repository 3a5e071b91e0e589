"""Hard-negative mining by residue-number-system GEMM (operator 11).

Components are integers.  Scores are exact integer inner products: both
matrices are reduced modulo several small primes to residues around zero, the
residue matrices are multiplied in float32 in runs of :data:`RUN` components (so
every partial sum stays below 2**24 and is exact), and the signed scores are
put together from the products' residues by mixed-radix digits (Chinese
remaindering).  As many primes are taken as the largest possible score needs.

The anchors (a stated set of queries) meet all rows in cells: a group of at most
:data:`GROUP` anchors and one of :data:`BLOCKS` blocks of rows, each cell a
partition of its own.  A task holds its anchors and their best so far and streams
its rows past them, so memory doesn't depend on the number of rows.  A first
pass finds each anchor's positives, a second one, with windows of scores set by
them, the negatives; each cell hands on the best of its block only, and these
are ranked once more over all blocks.  Every anchor meets every row.

Defined results: rows with a NULL id, label or vector, or with a NULL or
non-finite component, take no part; of rows with one id, the one with the smallest
(label, vector) takes part; a vector counts as continued with zeros where another
is longer (an empty one scores 0); ties go to the smaller id; anchors without a
positive, and positives without a negative in their window, give no rows; an
empty table gives none; scores that could pass 2**55 raise ``ValueError``; other
columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrate.llm.common import stored

POSITIVES, NEGATIVES = 5, 10
#: Negatives score between these hundredths of the positive's score.
LOW, HIGH = 30, 90
#: Each component is floor(SCALE * x).
SCALE = 256
#: Anchors in a group, blocks of rows, scores held at once, components in a run.
GROUP, BLOCKS, HELD, RUN = 4096, 12, 1 << 19, 1024
#: Candidates that are gathered before they are ranked.
GATHER = 1 << 20
_LIMIT = 1 << 55
_NO_SCORE = np.int64(-(1 << 62))


# --- exact products -------------------------------------------------------------------
def primes_for(bound: int) -> list[int]:
    """Primes below 256, largest first, whose product tells -bound..bound apart
    (with twice the room, as float32 may round a residue to the next one beyond
    the middle, which only the last digit must not be)."""
    found, product = [], 1
    for p in range(255, 2, -2):
        if product > 4 * bound:
            break
        if all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            found.append(p)
            product *= p
    if product <= 4 * bound:
        raise ValueError("scores too large")
    return found


def _centre(x: np.ndarray, p: int) -> np.ndarray:
    """Integers below 2**24 in size, reduced to -(p-1)/2..(p-1)/2 (float32, exact)."""
    return x - np.float32(p) * np.rint(x * np.float32(1 / p))


def residues(matrix: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """The matrix of whole numbers (float64) modulo each prime, around zero."""
    out = []
    for p in primes:
        r = np.fmod(matrix, p)  # exact for floats of any size
        out.append(_centre(r.astype(np.float32), p))
    return out


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products (int64) of the rows of two matrices of residues."""
    total, scale, digits = None, 1, []
    for k, p in enumerate(primes):
        r = None
        for at in range(0, max(1, a[k].shape[1]), RUN):
            part = _centre(a[k][:, at:at + RUN] @ b[k][:, at:at + RUN].T, p)
            r = part if r is None else _centre(r + part, p)
        for q, digit in digits:  # the mixed-radix digit: what the earlier digits leave
            r = _centre((r - digit) * np.float32(pow(q, -1, p)), p)
        digits.append((p, r))
        total = r.astype(np.int64) if total is None else total + r.astype(np.int64) * scale
        scale *= p
    return total


# --- a cell: anchors and the rows that stream past them ----------------------------------
def _matrix(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Rows of floor(SCALE * x) in float64, filled up with zeros to ``width``
    (None: the longest row's); longer rows are cut there, as the other side
    has zeros beyond."""
    ends = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(ends)
    if width is None:
        width = int(size.max(initial=0))
    out = np.zeros((len(size), width))
    place = np.arange(width)[None, :]
    here = place < size[:, None]
    out[here] = flat[(ends[:-1, None] + place)[here]]
    return np.floor(SCALE * out)


class Best:
    """The ``k`` best (highest score, then smallest id) of each slot."""

    def __init__(self, slots: int, k: int) -> None:
        self.k, self.slots = k, slots
        self.slot = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)
        self.id = np.empty(0, np.int64)
        self.least = np.full(slots, _NO_SCORE)  # a lower score can't enter
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.gathered = 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.new.append((slot, score, ids))
        self.gathered += len(slot)
        if self.gathered > max(GATHER, len(self.slot)):
            self.settle()

    def settle(self) -> None:
        if not self.new:
            return
        slot, score, ids = (np.concatenate(x) for x in zip((self.slot, self.score, self.id), *self.new))
        self.new, self.gathered = [], 0
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.searchsorted(slot, slot)
        rank = np.arange(len(slot)) - first
        self.least[slot[rank == self.k - 1]] = score[rank == self.k - 1]
        keep = rank < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]


class Cell:
    def __init__(self, batches: list[pa.RecordBatch], primes: list[int], negatives: bool) -> None:
        table = pa.Table.from_batches(batches).combine_chunks()
        self.ids = table["vec_id"].to_numpy()
        self.labels = table["label"].to_numpy()
        vec = table["vec"].combine_chunks()
        vec = vec.chunk(0) if isinstance(vec, pa.ChunkedArray) else vec
        matrix = _matrix(vec)
        self.width, self.primes, self.negatives = matrix.shape[1], primes, negatives
        self.residues = residues(matrix, primes)
        n = len(self.ids)
        if negatives:
            known = [[(p["id"], p["score"]) for p in x] for x in table["positives"].to_pylist()]
            self.positive = np.zeros((n, POSITIVES), np.int64)
            self.low, self.high = np.ones((n, POSITIVES), np.int64), np.zeros((n, POSITIVES), np.int64)
            self.positive_score = np.zeros((n, POSITIVES), np.int64)
            for i, row in enumerate(known):
                for j, (pid, score) in enumerate(row):
                    self.positive[i, j], self.positive_score[i, j] = pid, score
                    self.low[i, j] = -(-LOW * score // 100)
                    self.high[i, j] = HIGH * score // 100
            self.best = Best(n * POSITIVES, NEGATIVES)
        else:
            self.best = Best(n, POSITIVES)

    def meet(self, batch: pa.RecordBatch) -> None:
        n = max(1, HELD // max(1, len(self.ids)))
        for at in range(0, batch.num_rows, n):
            part = batch.slice(at, n)
            vec = pa.concat_arrays([part.column("vec")])
            got = scores(self.residues, residues(_matrix(vec, self.width), self.primes), self.primes)
            ids, labels = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
            same = self.labels[:, None] == labels[None, :]
            if not self.negatives:
                same &= self.ids[:, None] != ids[None, :]
                i, j = np.nonzero(same & (got >= self.best.least[:, None]))
                self.best.add(i, got[i, j], ids[j])
                continue
            least = self.best.least.reshape(-1, POSITIVES)
            for k in range(POSITIVES):
                floor = np.maximum(self.low[:, k], least[:, k])
                i, j = np.nonzero(~same & (got >= floor[:, None]) & (got <= self.high[:, k, None]))
                self.best.add(i * POSITIVES + k, got[i, j], ids[j])

    def result(self) -> pa.RecordBatch:
        self.best.settle()
        b = self.best
        if not self.negatives:
            return pa.RecordBatch.from_arrays(
                [pa.array(self.ids[b.slot]), pa.array(b.id), pa.array(b.score)],
                names=["anchor_id", "positive_id", "positive_score"])
        i, k = b.slot // POSITIVES, b.slot % POSITIVES
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[i]), pa.array(self.positive[i, k]), pa.array(self.positive_score[i, k]),
             pa.array(b.id), pa.array(b.score)],
            names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])


def _met(anchors: DataFrame, rows: DataFrame, groups: int, primes: list[int], negatives: bool) -> DataFrame:
    """The best of each cell.  Anchors go to the cells of their group, rows to
    those of their block; within a partition anchors come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        cell: Cell | None = None
        for batch in batches:
            role = batch.column("role").to_numpy()
            split = int(np.searchsorted(role, 1))
            if split:
                waiting.append(batch.slice(0, split))
            if split < batch.num_rows and waiting and cell is None:
                cell, waiting = Cell(waiting, primes, negatives), []
            if split < batch.num_rows and cell is not None:
                cell.meet(batch.slice(split))
        if cell is not None:
            yield cell.result()

    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups))
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(BLOCKS))
    asked = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).withColumn(
        "cell", (group * BLOCKS + F.col("block")).cast("int")).withColumn("role", F.lit(0)).drop("block")
    given = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn(
        "cell", (F.col("group") * BLOCKS + block).cast("int")).withColumn("role", F.lit(1)).drop("group")
    both = asked.unionByName(given, allowMissingColumns=True)
    out = "anchor_id long, positive_id long, positive_score long"
    return both.repartitionById(groups * BLOCKS, F.col("cell")).sortWithinPartitions("role", "vec_id").mapInArrow(
        run, out + (", negative_id long, negative_score long" if negatives else ""))


def taking_part(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, vec of the rows that take part, one for each id."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull()
                          & F.col(vector).isNotNull() & usable)
    one = F.min(F.struct(F.col("label").cast("long").alias("label"), F.col(vector).alias("vec"))).alias("row")
    return rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(one).select("vec_id", "row.*")


def mine(vectors: DataFrame, anchor: Column, label: Column | None = None, vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score
    for the anchors, the rows for which ``anchor`` (a condition on vec_id) holds.
    ``label`` replaces the column of that name."""
    rows = vectors if label is None else vectors.withColumn("label", label)
    rows = stored(taking_part(rows, vector), "vectors")
    size = F.aggregate("vec", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    n, width, largest = rows.agg(
        F.count_if(anchor), F.max(F.size("vec")), F.max(size)).first()
    bound = int(width or 0) * math.ceil(SCALE * (largest or 0.0) + 1) ** 2
    if bound >= _LIMIT:
        raise ValueError("scores of these vectors could pass 2**55")
    primes, groups = primes_for(max(1, bound)), max(1, math.ceil(n / GROUP))
    anchors = rows.filter(anchor)

    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = _met(anchors, rows, groups, primes, False)
    top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= POSITIVES)
    positives = top.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))).alias("positives"))
    asked = stored(anchors.join(positives, F.col("vec_id") == F.col("anchor_id")).select(
        *rows.columns, F.transform("positives", lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score")))
        .alias("positives")), "anchors")

    near = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return _met(asked, rows, groups, primes, True).withColumn("rank", F.row_number().over(near)).filter(
        F.col("rank") <= NEGATIVES).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
