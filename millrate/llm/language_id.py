"""Language identification by nearest centroid (operator 7).

A text becomes a TF-IDF vector of hashed byte n-grams (two and three bytes of
its lower-cased letters), normalised to length 1.  Labelled texts of each
language are clustered by cosine into several centroids.  A text gets the
language of its nearest centroid; it is rejected if it lies farther from it
than nearly all learned members by a margin, or has no letter.

The classifier is fitted on a bounded sample: at most ``PER_LANG`` labelled
texts per language, the smallest by a hash of their ids.  Prediction covers
every text, whole.

Defined results: a NULL text or one without a letter is ``und`` with score 0
and rejected; ties go to the language first in alphabetical order; without
labelled texts everything is ``und``; repeated rows are judged each; an empty
table gives no rows; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrate.llm.common import labelled_texts, pieces, stored

UNKNOWN = "und"
#: Documented bounds of the fit: labelled texts and centroids per language.
PER_LANG, CLUSTERS = 600, 4
#: Rejected below this share of the cosine that all but a hundredth of the members
#: reach.  Texts of fewer different n-grams than FULL_GRAMS lie farther from any
#: centroid: their cosines, members' too, are compared after division by closeness().
MARGIN, LOW_QUANTILE, FULL_GRAMS = 0.5, 0.01, 200
#: Spread of the softmax that turns cosines into a score.
TEMPERATURE = 0.05
BUCKET_BITS = 12
#: A centroid has this share of its language's sample or more, two texts at least.
LEAST_SHARE = 0.05
_ROUNDS, _STARTS = 30, 6
_SLAB = 1 << 20
_letter = regex.compile(r"\p{L}").search
# Everything but a-z and bytes of non-ASCII characters counts as a space.
_KEEP = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a whole text."""
    raw = b" " + b" ".join(text.lower().encode().translate(_KEEP).split()) + b" "
    out = np.zeros(2 << BUCKET_BITS)
    shift = np.uint32(32 - BUCKET_BITS)
    for start in range(0, len(raw), _SLAB):
        a = np.frombuffer(raw[start:start + _SLAB + 2], np.uint8).astype(np.uint32)
        two = (a[:-1] << np.uint32(8) | a[1:])
        out[:1 << BUCKET_BITS] += np.bincount(
            two[:_SLAB] * np.uint32(2654435761) >> shift, minlength=1 << BUCKET_BITS)
        three = two[:-1] << np.uint32(8) | a[2:]
        out[1 << BUCKET_BITS:] += np.bincount(
            three * np.uint32(2246822519) >> shift, minlength=1 << BUCKET_BITS)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(count) * idf)


def closeness(count: np.ndarray) -> np.ndarray:
    """How near texts of such n-gram counts come to a centroid, 1 for long texts."""
    return np.sqrt(np.minimum(1.0, (count > 0).sum(axis=-1) / FULL_GRAMS))


def lowest(x: np.ndarray, close: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For each centroid the low quantile of its members' cosine by closeness."""
    cosine = x @ centroids.T
    own = cosine.argmax(axis=1)
    return np.array([np.quantile(cosine[own == j, j] / close[own == j], LOW_QUANTILE)
                     if (own == j).any() else 0.0 for j in range(len(centroids))])


def _settle(like: np.ndarray, own: np.ndarray, rounds: int = _ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """K-means rounds from an assignment: the last one, and each member's cosine
    with each centroid.  ``like``: the members' cosines with each other."""
    for _ in range(rounds):
        _, own = np.unique(own, return_inverse=True)
        sums = like @ np.eye(own.max() + 1)[own]
        length = np.sqrt(np.bincount(own, weights=sums[np.arange(len(own)), own]))
        cosine = sums / np.maximum(length, 1e-12)
        now = cosine.argmax(axis=1)
        if (now == own).all():
            break
        own = now
    return own, cosine


def _split(like: np.ndarray, k: int, least: int, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Clusters of ``least`` members or more from one k-means++ start, and the sum
    of cosines.  Members of smaller clusters are no seeds any more; new seeds are
    drawn while there are, then smaller clusters go to their members' next ones."""
    n = len(like)
    may = np.ones(n, dtype=bool)
    seeds = [int(rng.integers(n))]
    while True:
        while len(seeds) < k:
            far = np.maximum(1 - like[:, seeds].max(axis=1), 0) * may
            if far.sum() <= 1e-9:
                break
            seeds.append(int(rng.choice(n, p=far / far.sum())))
        own, cosine = _settle(like, like[:, seeds].argmax(axis=1))
        sizes = np.bincount(own, minlength=cosine.shape[1])
        small = sizes[own] < least
        if not small.any() or not (may & small).any():
            break
        may &= ~small
        # Go on from a typical member of each cluster that is large enough.
        seeds = [int(np.where(own == j, cosine[:, j], -2).argmax()) for j in np.flatnonzero(sizes >= least)]
        if not seeds:
            seeds = [int(like.sum(axis=1).argmax())]
    while cosine.shape[1] > 1 and sizes.min() < least:
        kept = np.flatnonzero(np.arange(len(sizes)) != sizes.argmin())
        own, cosine = _settle(like, kept[cosine[:, kept].argmax(axis=1)])
        sizes = np.bincount(own, minlength=cosine.shape[1])
    return own, float(cosine[np.arange(n), own].sum())


def cluster(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means, the best of several k-means++ starts: centroids of
    ``LEAST_SHARE`` of the members or more, lowest member cosine."""
    like = x @ x.T
    least = max(2, int(np.ceil(LEAST_SHARE * len(x))))
    rng = np.random.default_rng(7)
    own, _ = max((_split(like, max(1, min(k, len(x) // least)), least, rng) for _ in range(_STARTS)),
                 key=lambda found: found[1])
    c = np.array([_unit(x[own == j].sum(axis=0)) for j in range(own.max() + 1)])
    return c, np.array([(x[own == j] @ c[j]).min() for j in range(len(c))])


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray     # one row per centroid
    owner: np.ndarray         # the language's place in langs
    low: np.ndarray           # lowest() of each centroid

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        """(lang, score, cosine, rejected) of each text."""
        real = [i for i, t in enumerate(texts) if t and _letter(t)] if self.langs else []
        out = [(UNKNOWN, 0.0, 0.0, True)] * len(texts)
        for k in range(0, len(real), 256):
            part = real[k:k + 256]
            count = np.array([counts(texts[i]) for i in part])
            cosine = vectors(count, self.idf) @ self.centroids.T
            by_lang = np.stack([np.where(self.owner == j, cosine, -1.0).max(axis=1)
                                for j in range(len(self.langs))], axis=1)
            best = by_lang.argmax(axis=1)
            at = np.where(self.owner == best[:, None], cosine, -2.0).argmax(axis=1)
            weight = np.exp((by_lang - by_lang.max(axis=1, keepdims=True)) / TEMPERATURE)
            score = weight[np.arange(len(part)), best] / weight.sum(axis=1)
            near = cosine[np.arange(len(part)), at]
            for i, b, s, c, low in zip(part, best, score, near, MARGIN * self.low[at] * closeness(count)):
                out[i] = (self.langs[b], float(min(1.0, s)), float(c), bool(c < low))
        return out


def fit(docs: DataFrame, labels: DataFrame, per_lang: int = PER_LANG, clusters: int = CLUSTERS) -> Model:
    """``labels``: doc_id, lang of rows of ``docs`` (doc_id, text)."""
    sample = labelled_texts(docs, labels, "lang", per_lang)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, max_bytes=1 << 20):
            real = [(lang, counts(t).astype(np.float32).tobytes())
                    for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist())
                    if _letter(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in real], pa.string()), pa.array([x[1] for x in real], pa.binary())],
                names=["lang", "grams"])

    grams = stored(sample.select("lang", "text").mapInArrow(featurise, "lang string, grams binary"), "lang-sample")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(2 << BUCKET_BITS)
        for batch in batches:
            for x in batch.column("grams").to_pylist():
                df += np.frombuffer(x, np.float32) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df.tobytes()])], names=["n", "df"])

    parts = grams.select("grams").mapInArrow(seen, "n long, df binary").collect()  # one row per task
    n = sum(p["n"] for p in parts)
    df = sum((np.frombuffer(p["df"]) for p in parts), np.zeros(2 << BUCKET_BITS))
    idf = np.log((1 + n) / (1 + df)) + 0.1

    def centres(group: pd.DataFrame) -> pd.DataFrame:  # at most per_lang rows
        group = group.sort_values("grams")  # the same draws in any order of rows
        count = np.array([np.frombuffer(g, np.float32) for g in group["grams"]], dtype=float)
        x = vectors(count, idf)
        c, _ = cluster(x, clusters)
        low = lowest(x, closeness(count), c)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "low": low, "centroid": [v.tobytes() for v in c]})

    found = grams.groupBy("lang").applyInPandas(centres, "lang string, low double, centroid binary").toPandas()
    found = found.sort_values(["lang", "low", "centroid"])
    langs = sorted(set(found["lang"]))
    return Model(langs, idf, np.array([np.frombuffer(c) for c in found["centroid"]]).reshape(len(found), 2 << BUCKET_BITS),
                 np.array([langs.index(x) for x in found["lang"]], dtype=int), found["low"].to_numpy(dtype=float))


_OUT = (("lang_pred", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64()),
        ("cosine", T.DoubleType(), pa.float64()), ("rejected", T.BooleanType(), pa.bool_()))


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs``, then lang_pred, score, cosine and rejected
    (with underscores added where ``keep`` has such a name)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # langs x clusters vectors
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    taken, names, kinds = {c.lower() for c in keep}, [], [k for _, _, k in _OUT]
    fields = list(rows.select(*keep).schema.fields)
    for name, kind, _ in _OUT:
        while name in taken:
            name += "_"
        names.append(name)
        fields.append(T.StructField(name, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            said = list(zip(*sent.value.judge(batch.column("text").to_pylist())))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *(pa.array(s, k) for s, k in zip(said, kinds))],
                names=[*keep, *names])

    return rows.mapInArrow(run, T.StructType(fields))
