"""Toxic spans by a linear-chain conditional random field (operator 4).

Words are tagged toxic or clean.  Words of labelled texts get their labels
from letter n-grams that texts marked toxic use far more often than clean ones
(log-likelihood ratio and log odds): in a toxic text a word with such an n-gram
is toxic, all other words are clean.  A CRF over these words learns weights for
the n-grams, word shapes and tag transitions by gradient ascent.  Forward and
backward passes give each word its marginal; a text's score is the calibrated
highest marginal, and words of marginal 0.5 or more are its offending spans.

The passes run over blocks of :data:`BLOCK` words side by side: each block's
2x2 transfer matrix first, then a scan over a text's blocks, then the words, so
the number of numpy steps hardly depends on a text's length.

The model is fitted on a bounded sample, ``PER_CLASS`` labelled texts of each
class by a hash of their ids; scoring covers every whole text.

Defined results: a NULL or empty text has the score of a text of clean words;
without toxic training texts every score is 0; repeated rows are scored each;
an empty table gives no rows; labels, lang, source and ids are never inputs.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrate.llm.common import bounded_sample, labelled_texts, pieces, stored

#: Documented bounds of the fit: labelled texts per class, and n-grams.
PER_CLASS, MAX_GRAMS = 2500, 4000
GRAM_SIZES = (3, 4, 5, 6, 7, 8)
#: An n-gram marks toxic words from these log odds and toxic texts on, if its
#: log-likelihood ratio reaches a floor: the lowest at which at most FALSE_SHARE of the
#: marking n-grams are expected by chance, however large the sample.
MIN_LOG_ODDS, MIN_TEXTS, FALSE_SHARE = 3.0, 3, 0.01
#: Texts of the sample that the CRF itself is trained on, and its steps.
CRF_TEXTS, CRF_STEPS, CRF_RIDGE = 1000, 80, 0.05
THRESHOLD = 0.7
BLOCK = 128
WORDS_SEEN = 400_000
_not_letters = re.compile(r"[\W\d_]+")
SHAPES = ("bias", "no_letters", "upper", "long")


def core(word: str) -> str:
    """A word's letters in lower case between brackets; '' without letters."""
    letters = _not_letters.sub("", word.lower())
    return f"<{letters}>" if letters else ""


def grams(token: str) -> set[str]:
    """The n-grams of a core, and the core itself."""
    return {token[i:i + n] for n in GRAM_SIZES for i in range(len(token) - n + 1)} | {token}


def shape(word: str, token: str) -> list[int]:
    return [0] + [1] * (not token) + [2] * (word.isupper() and len(token) > 3) + [3] * (len(token) > 14)


# --- the chain ----------------------------------------------------------------
# A clean word is taken to stand before and after each sequence.
_CLEAN = -1e3


def _messages(score: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Log odds of tag 1 that reach each word from its left.  ``score``: the
    words' own log odds, sequences of ``sizes`` words laid end to end;
    ``trans[a, b]``: weight of tag b after tag a."""
    per = -(-sizes // BLOCK)
    first = np.cumsum(per) - per
    place = np.arange(len(score)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, col = np.repeat(first, sizes) + place // BLOCK, place % BLOCK
    blocks = int(per.sum())
    own = np.zeros((BLOCK, blocks))
    real = np.zeros((BLOCK, blocks), dtype=bool)
    own[col, row], real[col, row] = score, True
    # move[a][b]: log weight of a block entered with tag a and left with tag b.
    zero, none = np.zeros(blocks), np.full(blocks, -np.inf)
    move = [[zero, none], [none, zero]]
    for t in range(BLOCK if (per > 1).any() else 0):
        on = real[t]
        move = [[np.where(on, np.logaddexp(m[0] + trans[0, b], m[1] + trans[1, b]) + b * own[t], m[b])
                 for b in (0, 1)] for m in move]
    enter = np.full(blocks, _CLEAN)
    for k in range(1, int(per.max(initial=0))):  # over the blocks of a sequence
        at = first[per > k] + k
        r = enter[at - 1]
        enter[at] = (np.logaddexp(move[0][1][at - 1], r + move[1][1][at - 1])
                     - np.logaddexp(move[0][0][at - 1], r + move[1][0][at - 1]))
    out = np.zeros((BLOCK, blocks))
    r = enter
    for t in range(min(BLOCK, int(sizes.max(initial=0)))):
        out[t] = np.logaddexp(trans[0, 1], r + trans[1, 1]) - np.logaddexp(trans[0, 0], r + trans[1, 0])
        r = out[t] + own[t]
    return out[col, row]


def chain(score: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: (messages from the left, messages from the right)."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    starts = ends - np.repeat(sizes, sizes)
    flip = ends - 1 - (np.arange(len(score)) - starts)  # reverses each sequence
    right = _messages(score[flip], sizes, trans.T)[flip]
    return _messages(score, sizes, trans), right


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(feature: np.ndarray, word: np.ndarray, label: np.ndarray, sizes: np.ndarray, width: int,
          steps: int = CRF_STEPS, ridge: float = CRF_RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by gradient ascent (Adam) on the mean
    log-likelihood.  Word ``word[i]`` has feature ``feature[i]``."""
    weight, trans = np.zeros(width), np.zeros((2, 2))
    moments = np.zeros((2, width + 4))
    n = max(1, len(label))
    inner = np.ones(n, dtype=bool)
    inner[np.cumsum(sizes) - sizes] = False  # words with a word before them
    here = np.flatnonzero(inner[:len(label)])
    seen = np.bincount(label[here - 1] * 2 + label[here], minlength=4)
    for step in range(1, steps + 1):
        score = np.bincount(word, weights=weight[feature], minlength=len(label))
        left, right = chain(score, sizes, trans)
        p = _sigmoid(left + score + right)
        g = np.bincount(feature, weights=(label - p)[word], minlength=width) / n - ridge / n * weight
        a, b = left[here - 1] + score[here - 1], score[here] + right[here]
        pair = np.stack([np.full(len(here), trans[0, 0]), trans[0, 1] + b, trans[1, 0] + a, trans[1, 1] + a + b])
        pair = np.exp(pair - pair.max(axis=0, initial=-np.inf))
        g2 = (seen - (pair / pair.sum(axis=0)).sum(axis=1)) / n - ridge / n * trans.ravel()
        g2[0] = 0.0  # tags 0, 0 are the scale's origin
        grad = np.concatenate([g, g2])
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad ** 2
        move = 0.3 * (moments[0] / (1 - 0.9 ** step)) / (np.sqrt(moments[1] / (1 - 0.99 ** step)) + 1e-9)
        weight += move[:width]
        trans += move[width:].reshape(2, 2)
    return weight, trans


# --- the model ----------------------------------------------------------------
@dataclass
class Model:
    grams: list[str]
    weight: np.ndarray            # of the n-grams, then of SHAPES
    trans: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    known: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.finder = ahocorasick.Automaton()
        for k, g in enumerate(self.grams):
            self.finder.add_word(g, k)
        self.finder.make_automaton()

    def __reduce__(self):
        return Model, (self.grams, self.weight, self.trans, self.scale)

    def features(self, word: str) -> list[int]:
        token, n = core(word), len(self.grams)
        marks = {k for _, k in self.finder.iter(token)} if n and token else ()
        return [*marks, *(n + k for k in shape(word, token))]

    def odds(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Posterior log odds of each word, and words per text."""
        cut = [t.split() for t in texts]
        if len(self.known) > WORDS_SEEN:
            self.known.clear()
        for w in set().union(*cut) - self.known.keys():
            self.known[w] = float(self.weight[self.features(w)].sum())
        sizes = np.array([len(x) for x in cut], dtype=np.int64)
        get = self.known.__getitem__
        score = np.fromiter((s for x in cut for s in map(get, x)), dtype=float, count=int(sizes.sum()))
        left, right = chain(score, sizes, self.trans)
        return left + score + right, sizes

    def peaks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        odds, sizes = self.odds(texts)
        low = float(self.weight[len(self.grams)]) if len(self.weight) else 0.0
        top = np.full(len(texts), min(low, -5.0))
        some = sizes > 0
        if some.any():
            top[some] = np.maximum.reduceat(odds, (np.cumsum(sizes) - sizes)[some])
        return np.clip(top, -15, 15), odds, sizes

    def judge(self, texts: list[str]) -> list[tuple[float, list[dict]]]:
        """(score, offending spans) of each text."""
        top, odds, sizes = self.peaks(texts)
        score = _sigmoid(self.scale[0] * top + self.scale[1])
        spans: list[list[dict]] = [[] for _ in texts]
        ends = np.cumsum(sizes)
        toxic = np.flatnonzero(odds >= 0)
        for i in np.unique(np.searchsorted(ends, toxic, side="right")).tolist():
            base = int(ends[i] - sizes[i])
            mine = odds[base:base + sizes[i]]
            for m, o in zip(re.finditer(r"\S+", texts[i]), mine.tolist()):
                if o >= 0:
                    spans[i].append({"start": m.start(), "end": m.end(), "p": float(_sigmoid(o))})
        return list(zip(score.tolist(), spans))


def _calibrate(top: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve (Newton steps, small ridge)."""
    x = np.stack([top, np.ones_like(top)], axis=1)
    b = np.zeros(2)
    for _ in range(30):
        p = _sigmoid(x @ b)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.05, 0.05])
        b += np.linalg.solve(h, x.T @ (label - p) - 0.05 * b)
    return float(max(b[0], 1e-3)), float(b[1])


def _marking_grams(sample: DataFrame, max_grams: int) -> list[str]:
    """The n-grams that toxic texts of ``sample`` (text, toxic) use far more
    often than clean ones, by the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: tuple[Counter, Counter] = Counter(), Counter()
        for batch in pieces(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                used[toxic].update(set().union(*map(grams, {core(w) for w in text.split()} - {""})))
                used[toxic][""] += 1
        keys = list(used[0].keys() | used[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), *(pa.array([used[k][g] for g in keys], pa.int64()) for k in (1, 0))],
            names=["gram", "toxic", "clean"])

    counted = stored(sample.mapInArrow(count, "gram string, toxic long, clean long")
                     .groupBy("gram").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
                     .filter((F.col("gram") == "") | (F.col("a") >= MIN_TEXTS)), "toxic-grams")
    total = counted.filter("gram = ''").first()
    if not total or not total["a"]:
        return []
    n1, n0 = float(total["a"]), float(total["b"])

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    a, b = F.col("a"), F.col("b")
    share = (a + b) / F.lit(n1 + n0)
    ratio = 2 * (part(a, share * n1) + part(b, share * n0)
                 + part(n1 - a, (1 - share) * n1) + part(n0 - b, (1 - share) * n0))
    odds = F.log((a + 0.5) / (n1 - a + 0.5)) - F.log((b + 0.5) / (n0 - b + 0.5))
    tested = counted.filter("gram <> ''")
    found = (tested.withColumn("ratio", ratio).filter(odds >= MIN_LOG_ODDS)
             .orderBy(F.desc("ratio"), "gram").limit(max_grams).select("gram", "ratio").collect())
    return [r["gram"] for r in found[:_above_chance([r["ratio"] for r in found], tested.count())]]


def _above_chance(ratios: list[float], tested: int) -> int:
    """How many of the falling ``ratios`` mark, by Benjamini and Hochberg's rule: chance
    gives a ratio or more to at most exp(-ratio / 2) of the n-grams ``tested``."""
    expected = np.exp(-np.array(ratios) / 2) * tested
    inside = np.flatnonzero(expected <= FALSE_SHARE * np.arange(1, len(ratios) + 1))
    return int(inside[-1]) + 1 if len(inside) else 0


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS,
        max_grams: int = MAX_GRAMS) -> Model | None:
    """``labels``: doc_id, toxic (0 or 1; others take no part) of rows of ``docs``
    (doc_id, text)."""
    sample = stored(labelled_texts(docs, labels.filter("toxic IN (0, 1)"), "toxic", per_class), "toxic-sample")
    marks = _marking_grams(sample.select("text", "toxic"), max_grams)
    if not marks:
        return None
    model = Model(marks, np.zeros(len(marks) + len(SHAPES)), np.zeros((2, 2)))

    # The CRF's own texts: a fixed number, small enough for one machine.
    chosen = bounded_sample(sample, "toxic", CRF_TEXTS // 2)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for i, text, toxic in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic"))):
                each = [model.features(w) for w in text.split()]
                rows.append((i, [int(toxic and any(k < len(marks) for k in x)) for x in each],
                             [len(x) for x in each], [k for x in each for k in x]))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), *(pa.array(c, pa.list_(pa.int32())) for c in cols[1:])],
                names=["doc_id", "label", "per_word", "feature"])

    got = chosen.mapInArrow(featurise, "doc_id long, label array<int>, per_word array<int>, feature array<int>")
    rows = got.toPandas().sort_values("doc_id")  # CRF_TEXTS rows at most
    rows = rows[rows["label"].map(len) > 0]

    def flat(name: str) -> np.ndarray:
        return np.concatenate([np.empty(0, int), *rows[name]]).astype(int)

    per_word, label = flat("per_word"), flat("label")
    model.weight, model.trans = train(
        flat("feature"), np.repeat(np.arange(len(label)), per_word), label,
        rows["label"].map(len).to_numpy(dtype=int), len(model.weight))

    def peak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            top = model.peaks(batch.column("text").to_pylist())[0]
            yield pa.RecordBatch.from_arrays([pa.array(top), batch.column("toxic")], names=["top", "toxic"])

    tops = sample.select("text", "toxic").mapInArrow(peak, "top double, toxic int").toPandas()
    tops = tops.sort_values(["top", "toxic"])  # two numbers for each text of the sample
    model.scale = _calibrate(tops["top"].to_numpy(float), tops["toxic"].to_numpy(float))
    return model


_WORKER: dict[str, Model | None] = {}


def worker_model(number: str, sent) -> Model | None:
    """The broadcast model, with its words seen kept between a worker's tasks."""
    if number not in _WORKER:
        _WORKER.clear()
        _WORKER[number] = sent.value
    return _WORKER[number]


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, spans (start, end, p of each offending word)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_GRAMS weights
    number = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = worker_model(number, sent)
        for batch in pieces(batches):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            said = mine.judge(texts) if mine else [(0.0, [])] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in said], pa.float64()),
                 pa.array([x[1] for x in said], pa.list_(pa.struct(
                     [("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))],
                names=["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>")
