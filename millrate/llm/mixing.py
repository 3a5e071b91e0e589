"""Mixing sources to target weights by soft membership (operator 8).

A naive Bayes classifier over hashed words, learned from a labelled table,
gives each document's posterior over domains.  Documents get nonnegative rates
(expected numbers of copies) whose expected token totals per domain match the
targets: with n a document's tokens, p its posterior, S = sum(rate * n * p) and
the targets T, the rates minimise (S - T)' W (S - T) over rates of zero or more,
from all rates 1, where W is the inverse of the domains' Gram matrix
sum(n * p * p').  Targets that can be met are met for any such W; this one makes
the squares well conditioned however much the domains overlap.

Projected gradient, in the metric that weighs a document by its tokens, is

    rate <- max(0, rate - p' W (S - T))

whose step is safe, as W scales the gradient's curvature to 1; while no rate
reaches zero a single step is exact.  Beyond, Nesterov's momentum is added: the
step starts from rate + b * (rate - rate before), where S follows by linearity.
The Gram matrix and each step are distributed sums; the driver sees domains times
domains numbers.  A narrow table (tokens, posterior, rate and rate before) is written
anew every few steps, so a step costs the same however many came before; the documents'
own rates follow from the posterior and the list of all steps.  Only DataFrame functions
run, without any shuffle of documents.  The fit ends when the targets are met or the
totals stand still (as near as rates of zero or more come), ``left`` being the largest
difference in tokens; it raises ``RuntimeError`` if neither happens.

The classifier is fitted on a bounded sample of ``PER_DOMAIN`` labelled texts of
each domain; posteriors, totals and rates cover all documents.

Defined results: a NULL or blank text has no tokens and the domains' posterior
of a text without words (their shares of the labels); without labelled texts posteriors are
uniform;
a domain without any expected tokens can't be reached and is left out; labels
of unknown domains take no part; repeated rows get equal rates and copies; an
empty table gives no rows; clashing column names get a number.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrate.llm.common import free_name, labelled_texts, stored, text_or_empty
from millrate.session import drop_table

#: Documented bound of the fit: labelled texts per domain.
PER_DOMAIN = 1500
BUCKETS = 1 << 14
#: Words whose evidence counts in full; more words don't sharpen a posterior.
FULL_WORDS = 50
#: Shares of all tokens: met targets, totals that stand still; and steps after which
#: the fit raises.
TOLERANCE, STILL, MAX_STEPS = 1e-6, 1e-8, 1000
#: Steps after which each row's rate is stored, so that a pass replays as many at most.
REPLAYED = 4
_WORDS = r"[\x20\x09-\x0D]+"


def word_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    words = F.filter(F.split(F.lower(text), _WORDS), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def word_weights(docs: DataFrame, labels: DataFrame, domains: list[str], per_domain: int = PER_DOMAIN,
                 buckets: int = BUCKETS) -> dict[str, tuple[float, list[float]]]:
    """Each domain's log share of the labels, and its log probabilities of
    the buckets less their mean over domains: domains times buckets numbers."""
    spark = docs.sparkSession
    labels = labels.filter(F.col("domain").isin(domains))
    sample = labelled_texts(docs, labels, "domain", per_domain)
    counted = stored(
        sample.select("domain", F.explode(word_buckets(F.col("text"), buckets)).alias("bucket"))
        .groupBy("domain", "bucket").agg(F.count(F.lit(1)).alias("n")), "domain-words")
    grid = spark.range(buckets).select(
        F.col("id").cast("int").alias("bucket"),
        F.explode(F.array(*map(F.lit, domains))).alias("domain"))
    total = counted.groupBy("domain").agg(F.sum("n").alias("total"))
    full = (grid.join(counted, ["domain", "bucket"], "left").join(total, "domain", "left")
            .select("domain", "bucket", F.log(
                (F.coalesce("n", F.lit(0)) + 0.5) / (F.coalesce("total", F.lit(0)) + 0.5 * buckets)).alias("w")))
    mean = full.groupBy("bucket").agg(F.avg("w").alias("mean"))
    pair = F.struct("bucket", (F.col("w") - F.col("mean")).alias("w"))
    rows = full.join(mean, "bucket").groupBy("domain").agg(
        F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["w"]).alias("weights")).collect()
    seen = {r["domain"]: r["count"] for r in labels.groupBy("domain").count().collect()}
    return {r["domain"]: (math.log(seen.get(r["domain"], 0) + 1.0), r["weights"]) for r in rows}


def logits(words: Column, weights: dict[str, tuple[float, list[float]]], domains: list[str]) -> Column:
    """The evidence of a row's word buckets for each of ``domains``, an array."""
    scale = F.lit(float(FULL_WORDS)) / F.greatest(F.size(words), F.lit(FULL_WORDS))

    def evidence(domain: str) -> Column:
        # Folded to one constant array: BUCKETS numbers, whatever the input.
        prior, each = weights[domain]
        w = F.split(F.lit(",".join(f"{x:.6g}" for x in each)), ",").cast("array<double>")
        return F.lit(prior) + scale * F.aggregate(words, F.lit(0.0), lambda a, b: a + F.get(w, b))

    return F.array(*map(evidence, domains))


def softmax(logit: Column) -> Column:
    total = F.aggregate(logit, F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max(logit)))
    return F.transform(logit, lambda x: F.exp(x - F.array_max(logit)) / total)


class Mixed:
    """Documents with tokens, posterior and rate."""

    def __init__(self, docs: DataFrame, labels: DataFrame, targets: dict[str, float],
                 per_domain: int = PER_DOMAIN) -> None:
        """``labels``: doc_id, domain of rows of ``docs``."""
        if not targets or min(targets.values()) < 0 or not sum(targets.values()):
            raise ValueError("give nonnegative target weights with a positive sum")
        self.domains = sorted(targets)
        share = [targets[d] / sum(targets.values()) for d in self.domains]
        self.columns = docs.columns
        self.words, self.tokens, self.posterior, self.rate, self.copies = (
            free_name(docs.columns, c) for c in ("word_buckets", "n_tokens", "posterior", "rate", "copies"))
        weights = word_weights(docs, labels, self.domains, per_domain)
        listed = docs.withColumn(self.words, word_buckets(text_or_empty()))
        judged = listed.select(
            *docs.columns, F.size(self.words).cast("long").alias(self.tokens),
            logits(F.col(self.words), weights, self.domains).alias(self.posterior))
        self.scored = stored(judged.withColumn(self.posterior, softmax(F.col(self.posterior))), "posteriors")
        self.steps: list[list[float]] = []
        k = range(len(self.domains))
        n, p = F.col(self.tokens), F.col(self.posterior)
        gram = self.scored.agg(*[F.coalesce(F.sum(n * p[i] * p[j]), F.lit(0.0)) for i in k for j in k]).first()
        gram = [[gram[len(k) * i + j] for j in k] for i in k]
        inverse = np.linalg.pinv(np.array(gram), rcond=1e-9, hermitian=True)
        self.base = [sum(row) for row in gram]  # a posterior sums to 1
        self.goal = goal = [x * sum(self.base) for x in share]
        now = before = np.array(self.base)
        momentum = 1.0
        self._state = self.scored.select(
            n.alias("n"), p.alias("p"), F.lit(1.0).alias("now"), F.lit(1.0).alias("before"))
        self._held = 0  # steps that the state has
        while True:
            self.left = max((abs(s - t) for s, t, b in zip(now, goal, self.base) if b > 0), default=0.0)
            still = bool(self.steps) and np.abs(now - before).max() <= STILL * sum(goal)
            if self.left <= TOLERANCE * sum(goal) or still:
                break  # met, or as near as rates of zero or more come
            if len(self.steps) == MAX_STEPS:
                raise RuntimeError(f"rates don't settle; {self.left:.0f} tokens are off target")
            longer = (1 + math.sqrt(1 + 4 * momentum ** 2)) / 2
            ahead = (momentum - 1) / longer
            momentum = longer
            off = now + ahead * (now - before) - goal
            self.steps.append([*(inverse @ off).tolist(), ahead])
            before, now = now, np.array(self.totals())
        if self._held:
            drop_table(self._state)

    def _moved(self, two: Column, p: Column, steps: list[list[float]]) -> Column:
        """(rate, rate before) of a row with posterior ``p`` after more steps."""
        if not steps:
            return two
        k = len(self.domains)
        steps = F.array(*[F.array(*map(F.lit, s)) for s in steps])

        def dot(step: Column) -> Column:
            return F.aggregate(F.zip_with(F.slice(step, 1, k), p, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)

        def move(two: Column, step: Column) -> Column:
            ahead = F.element_at(step, k + 1)
            start = two[0] + ahead * (two[0] - two[1])
            return F.array(F.greatest(F.lit(0.0), start - dot(step)), two[0])

        return F.aggregate(steps, two, move)

    def _rate(self) -> Column:
        """The rate of a row of the documents."""
        two = self._moved(F.array(F.lit(1.0), F.lit(1.0)), F.col(self.posterior), self.steps)
        return F.round(two[0], 9)

    def totals(self) -> list[float]:
        """Expected tokens of each domain at the present rates."""
        two = self._moved(F.array("now", "before"), F.col("p"), self.steps[self._held:])
        moved = self._state.select("n", "p", two.alias("two"))
        if len(self.steps) - self._held >= REPLAYED:
            old, had = self._state, self._held
            self._state = stored(moved.select("n", "p", F.col("two")[0].alias("now"), F.col("two")[1].alias("before")),
                                 "rates")
            self._held = len(self.steps)
            if had:
                drop_table(old)
            moved = self._state.select("n", "p", F.array("now", "before").alias("two"))
        weight = F.round(F.col("two")[0], 9) * F.col("n")
        got = moved.select(weight.alias("w"), "p").agg(*[
            F.coalesce(F.sum(F.col("w") * F.col("p")[k]), F.lit(0.0)) for k in range(len(self.domains))])
        return list(got.first())

    def rated(self) -> DataFrame:
        """All rows with tokens, posterior, rate, and copies: the rate rounded up
        or down by a hash of the row, so that their mean is the rate."""
        chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 52)) / F.lit(float(1 << 52))
        return self.scored.withColumn(self.rate, self._rate()).withColumn(
            self.copies, F.floor(F.col(self.rate) + chance).cast("int"))

    def drawn(self) -> DataFrame:
        """The rows of the mixture, each as often as its copies."""
        return self.rated().filter(F.col(self.copies) > 0).select(
            *self.columns, F.explode(F.sequence(F.lit(1), F.col(self.copies))).alias(self.copies)).select(*self.columns)
