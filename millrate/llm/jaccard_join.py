"""N-gram Jaccard join in the metric space of shingle sets (operator 12).

1 - Jaccard similarity is a metric d, so with eps the largest distance of a
link: what is within eps of a pivot p and linked with y has y within 2 eps of p.

1. Equal sets are one node.  Two nodes with a link share a shingle among the
   first n - ceil(t n) + 1 of the larger and the first m - ceil(2 t m / (1 + t)) + 1
   of the smaller one, in one order of all shingles.  Frequent shingles come last
   in that order; any order gives the same links.
2. Of the nodes that share such a shingle, each is a pivot if they are few; else
   the smallest that has it among the fewer first ones (an owner) is, and a pivot
   and all nodes that met it are a region.  Two nodes that own none of what they
   share need not meet: only owners become pivots.
3. A region's nodes are compared with its pivots.  A node within eps of some
   pivots belongs to the Voronoi cell of the nearest; a node of another cell
   within 2 eps of a pivot is replicated into that pivot's region as its window,
   unless it is connected with the pivot already; nodes within eps of no pivot
   are a region of their own.  A region that windows would replicate more than
   1.5 times stays whole, without its pivots.  These regions join in the same way, with more
   pivots in each round, until a region's nodes are all pivots or all
   connected.  A pair with a link thus meets a pivot, is connected through one, or
   goes into one region of the next round together.

Every comparison is of a node and a pivot: in a large group of near copies few
pivots connect most nodes, and no pairs within it are formed.  A histogram of
hashed shingles bounds the intersection from above and settles distant pairs;
others are compared by their whole sets.

Shingles are 64-bit hashes of word hashes; sets, counts and similarities are
exact but for hashes that agree by chance (2**-64 a pair), node ids likewise.

Defined results: a NULL or blank text has no shingles, and each such document
is its own component; NULL ids have no part in a component's smallest id (a
component of NULL ids only has none); repeated rows are reported each; whole
texts are used, however long; an empty table gives no rows; other columns take
no part.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrate.llm.common import pieces, stored, text_or_empty
from millrate.llm.simhash import components

SHINGLE, PERCENT = 5, 80
#: Pivots of a region in its first round of several, and how many times more in each next one.
PIVOTS, MORE = 16, 16
#: Frequent shingles that go last: in more documents than this (fewer nodes are all
#: pivots), the most frequent ones first, up to a bound of what is broadcast; the share of a
#: set, in first sizes, that is counted one by one; shingles held at once to count those
#: that documents share.  They change no result.
FREQUENT, FREQUENT_KEPT, COUNTED, RUN = 32, 1 << 18, 1, 1 << 21
#: Nodes whose ids are broadcast at most to find their texts, histograms and sets; more are joined.
BROADCAST_NODES = 1_000_000
#: A region is split if its parts hold at most so many times its rows.
DENSE = 1.5
#: Rows of a region that meet its pivots in one task.
SALT_ROWS = 50_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


# --- shingle sets -------------------------------------------------------------------
def shingles(text: str, k: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the text's different shingles."""
    words = text.encode().lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(k, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = (out ^ h[i:i + len(out)]) * _STEP
        out ^= out >> np.uint64(32)
    out *= _MIX
    return np.unique(out ^ out >> np.uint64(29))


def prefix_size(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1


def owned_size(n: int, percent: int) -> int:
    return n + (-2 * percent * n // (100 + percent)) + 1


def histogram(hashes: np.ndarray) -> bytes:
    """How many hashes fall in each of a power of two of buckets, one for two
    hashes or more; 255: that many or more."""
    size = max(16, 1 << (max(1, len(hashes)) - 1).bit_length() >> 1)
    counts = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def most_common(a: bytes, b: bytes) -> float:
    """An upper bound of the size of the intersection of two sets."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if 255 in x or 255 in y:
        return float("inf")
    x, y = x.astype(np.int64), y.astype(np.int64)
    while len(x) > len(y):
        x = x[:len(x) // 2] + x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] + y[len(y) // 2:]
    return float(np.minimum(x, y).sum())


def _short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _frequent(docs: DataFrame, k: int, percent: int) -> np.ndarray:
    """Sorted upper halves of the hashes that many documents have.  Of a task's
    documents, in runs of :data:`RUN` shingles, all counts of their first shingles
    are added up, and those of other shingles that several documents share."""

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        first = np.concatenate([np.arange(len(s)) < COUNTED * prefix_size(len(s), percent) for s in sets])
        key, place, n = np.unique(_short(np.concatenate(sets)), return_inverse=True, return_counts=True)
        wanted = n > 1
        wanted[place[first]] = True
        return pa.RecordBatch.from_arrays([pa.array(key[wanted]), pa.array(n[wanted])], names=["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in pieces(batches):
            for text in batch.column("text").to_pylist():
                if text and len(s := shingles(text, k)):
                    held.append(s)
                    size += len(s)
                    if size >= RUN:
                        yield counted(held)
                        held, size = [], 0
        if held:
            yield counted(held)

    counts = docs.select("text").mapInArrow(run, "key int, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") > FREQUENT).orderBy(F.desc("n"), "key").limit(FREQUENT_KEPT).select("key")
    return np.sort(np.array([r["key"] for r in top.collect()], dtype=np.int32))


def profiles(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, node (its set's id, NULL for none), n, keys (the first
    shingles in the common order), owned (how many of them it owns), hist."""
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), "text")
    late = _frequent(rows, k, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            node, n, keys, owned, hist = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text or "", k)
                n.append(len(s))
                node.append(node_id(s))
                last = late[np.searchsorted(late[:-1], _short(s))] == _short(s) if len(late) else np.zeros(len(s), bool)
                first = np.concatenate([s[~last], s[last]])[:prefix_size(len(s), percent)] if len(s) else s
                keys.append(first.view(np.int64))
                owned.append(owned_size(len(s), percent) if len(s) else 0)
                hist.append(histogram(s))
            ends = np.cumsum([0] + [len(x) for x in keys]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(node, pa.int64()),
                 pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *keys]))),
                 pa.array(owned, pa.int32()), pa.array(hist, pa.binary())],
                names=["doc_id", "text_hash", "node", "n", "keys", "owned", "hist"])

    return rows.mapInArrow(run, "doc_id long, text_hash long, node long, n long, keys array<long>, owned int, "
                                "hist binary")


def node_id(s: np.ndarray) -> int | None:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)) if len(s) else None


# --- comparing pairs ------------------------------------------------------------------
class Comparer:
    """Distances of pairs of nodes, with the sets of the nodes that were needed."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> None:
        """``nodes``: node, n, text_hash (of a text that has the set), hist."""
        self.docs, self.nodes, self.k, self.percent = docs, nodes, k, percent
        self.near = max(0, 2 * percent - 100)  # similarity of the triangle's far corner, in hundredths
        self.sets: DataFrame | None = None

    def narrow(self, members: DataFrame) -> None:
        """From now on only nodes of ``members`` are compared, so what is joined
        with their pairs holds no others."""
        kept = members.select("node")
        kept = F.broadcast(kept) if kept.count() <= BROADCAST_NODES else kept
        self.nodes = stored(self.nodes.join(kept, "node", "left_semi"), "region-nodes")
        if self.sets is not None:
            self.sets = stored(self.sets.join(kept, "node", "left_semi"), "region-sets")

    def _possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sizes and histograms don't put them beyond 2 eps."""
        near = self.near

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                c = {name: batch.column(name).to_pylist() for name in ("n_a", "n_b", "hist_a", "hist_b")}
                keep = [100 * (m := min(most_common(g, h), x, y)) >= near * (x + y - m)
                        for x, y, g, h in zip(c["n_a"], c["n_b"], c["hist_a"], c["hist_b"])]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        def side(name: str) -> DataFrame:
            return self.nodes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"),
                                     F.col("hist").alias(f"hist_{name}"))

        sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(
            100 * F.least("n_a", "n_b") >= near * F.greatest("n_a", "n_b"))
        return sized.mapInArrow(run, "a long, b long")

    def _learn(self, wanted: DataFrame) -> None:
        """Read the texts of the wanted nodes whose sets aren't stored yet."""
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("node"), "node", "left_anti")
        wanted = stored(self.nodes.join(wanted, "node", "left_semi").select("node", "text_hash"), "wanted")
        n = wanted.count()
        if not n:
            return
        hashes = wanted.select("text_hash").distinct()
        rows = self.docs.select(F.xxhash64(text_or_empty()).alias("text_hash"), "text").join(
            F.broadcast(hashes) if n <= BROADCAST_NODES else hashes, "text_hash", "left_semi")
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()  # copies in this task, by text hash
            for batch in pieces(batches):
                node, sets = [], []
                for h, text in zip(batch.column("text_hash").to_pylist(), batch.column("text").to_pylist()):
                    if h not in seen:
                        seen.add(h)
                        s = shingles(text or "", k)
                        node.append(node_id(s))
                        sets.append(s.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

        found = rows.mapInArrow(run, "node long, shingles array<long>").join(
            wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
        new = stored(found, "shingle-sets")
        self.sets = new if self.sets is None else self.sets.unionByName(new)

    def distances(self, pairs: DataFrame) -> DataFrame:
        """a, b, distance, linked of the pairs (a, b) of up to 2 eps."""
        close = stored(self._possible(pairs), "close")
        self._learn(close.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        if self.sets is None:
            return close.select("a", "b", F.lit(0.0).alias("distance"), F.lit(False).alias("linked"))
        a, b = (self.sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
        both = F.size(F.array_intersect("set_a", "set_b"))
        met = close.join(a, "a").join(b, "b").select(
            "a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b") - both).alias("either"))
        return stored(met.filter(100 * F.col("both") >= self.near * F.col("either")).select(
            "a", "b", (1 - F.col("both") / F.col("either")).alias("distance"),
            (100 * F.col("both") >= self.percent * F.col("either")).alias("linked")), "distances")


# --- regions ----------------------------------------------------------------------------
def _shared(rows: DataFrame) -> DataFrame:
    """key, node, own, region (the smallest owner of the key), many: the nodes
    that share one of their first shingles with an owner of it."""
    keyed = rows.select("node", "owned", F.posexplode("keys").alias("place", "key")).select(
        "key", "node", (F.col("place") < F.col("owned")).alias("own"))
    shared = keyed.groupBy("key").agg(
        F.min("node").alias("a"), F.max("node").alias("b"), F.min(F.when(F.col("own"), F.col("node"))).alias("region"),
        F.count(F.lit(1)).alias("n")).filter("a < b and region is not null").select(
        "key", "region", (F.col("n") > FREQUENT).alias("many"))
    return keyed.join(shared, "key")


def _all_pivots(shared: DataFrame) -> DataFrame:
    """(a, b), a < b, of each key with few nodes (at most :data:`FREQUENT`)."""
    few = shared.filter(~F.col("many")).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("node", "own"))).alias("nodes"))
    size = F.size("nodes")
    pairs = F.flatten(F.transform(F.slice("nodes", 1, size - 1), lambda a, i: F.transform(
        F.slice("nodes", i + 2, size), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return few.select(F.explode(pairs).alias("p")).filter("p.a.own or p.b.own").select(
        F.col("p.a.node").alias("a"), F.col("p.b.node").alias("b")).distinct()


def _connected(links: DataFrame | None, members: DataFrame) -> DataFrame:
    """members with comp, the root of each node's component so far."""
    if links is None:
        return members.withColumn("comp", F.col("node"))
    tree = links.select(F.col("node").alias("of"), "root")
    return members.join(tree, F.col("node") == F.col("of"), "left").withColumn(
        "comp", F.coalesce("root", "node")).drop("of", "root")


def _pivots(members: DataFrame, most: int, salt: int) -> DataFrame:
    """region, pivot, home (its component), salts: up to ``most`` pivots for each
    region, all its owners if there are as few; those of smaller components first."""
    counts = stored(members.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("in_comp")), "component-counts")
    size = counts.groupBy("region").agg(F.sum("in_comp").alias("size"))
    few = F.col("size") <= most
    place = F.when(few, F.xxhash64("node")).otherwise(F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(most)))
    return (members.filter("own").join(counts, ["region", "comp"]).join(size, "region")
            .groupBy("region", place.alias("place"))
            .agg(F.min(F.struct("in_comp", F.xxhash64("node").alias("h"), "node", "comp")).alias("least"),
                 F.max("size").alias("size"))
            .select("region", F.col("least.node").alias("pivot"), F.col("least.comp").alias("home"),
                    F.ceil(F.col("size") / SALT_ROWS).cast("int").alias("salts")))


def _meetings(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """region, pivot, node: each node of a region with each of its pivots that it
    isn't connected with.  A large region's nodes are dealt out by salt; its pivots
    go to all salts."""
    salts = pivots.groupBy("region").agg(F.max("salts").alias("salts"))
    dealt = members.join(salts, "region").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    asked = pivots.select("region", "pivot", "home", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return dealt.join(asked, ["region", "salt"]).filter("comp <> home").select("region", "pivot", "node")


def _split(met: DataFrame, members: DataFrame, pivots: DataFrame, links: DataFrame, salt: int) -> DataFrame:
    """The regions of the next round.  ``met``: region, pivot, node, distance, linked.
    Each step is stored, so that the next one's plan is short: one plan for all of
    them holds most of its branches many times, and fills the driver's memory."""
    rest = members.join(pivots.select("region", F.col("pivot").alias("node")), ["region", "node"], "left_anti")
    cell = met.filter("linked").groupBy("region", "node").agg(
        F.min(F.struct("distance", "pivot"))["pivot"].alias("cell"))
    placed = stored(_connected(links, rest.join(cell, ["region", "node"], "left").select(
        "region", "node", "own", "cell")), "placed-nodes")

    def new(*keys: str) -> list[Column]:
        return [F.col("region").alias("parent"), F.xxhash64("region", *keys, F.lit(salt)).alias("region")]

    far = placed.filter("cell is null").select(*new(), "node", "own", "comp")
    cells = placed.filter("cell is not null").select("region", F.col("cell").alias("pivot"), "node", "own", "comp")
    root = _connected(links, pivots.select("region", F.col("pivot").alias("node"))).select(
        "region", F.col("node").alias("pivot"), F.col("comp").alias("home"))
    window = stored(
        met.select("region", "pivot", "node").join(placed, ["region", "node"])
        .filter(~F.col("cell").eqNullSafe(F.col("pivot")))
        .join(root, ["region", "pivot"]).filter("comp <> home").select("region", "pivot", "node", "own", "comp"),
        "windows")
    open_cells = window.select("region", "pivot").distinct()
    near = cells.join(open_cells, ["region", "pivot"], "left_semi").unionByName(window).select(
        *new("pivot"), "node", "own", "comp")
    split = stored(far.unionByName(near).distinct(), "split-regions")
    # Where windows take in most of a dense region, it stays whole, less its pivots.
    before = placed.groupBy("region").agg(F.count(F.lit(1)).alias("before"))
    dense = stored(split.groupBy("parent").agg(F.count(F.lit(1)).alias("after")).join(
        before, F.col("parent") == F.col("region")).filter(F.col("after") > DENSE * F.col("before")).select("parent"),
        "dense-regions")
    if dense.isEmpty():
        return split.drop("parent")
    whole = placed.select(*new(), "node", "own", "comp").join(dense, "parent", "left_semi")
    return stored(split.join(dense, "parent", "left_anti").unionByName(whole).drop("parent"), "next-regions")


def _open(members: DataFrame) -> DataFrame:
    """The regions that have owners, and nodes of several components."""
    several = members.groupBy("region").agg(
        F.min("comp").alias("a"), F.max("comp").alias("b"), F.max("own").alias("own")).filter(
        "own and a < b").select("region")
    return members.join(several, "region", "left_semi")


def link_tree(docs: DataFrame, rows: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """node, root of all nodes that are linked with another, but the roots."""
    compare = Comparer(docs, nodes, k, percent)
    shared = stored(_shared(rows), "shared-shingles")
    members = stored(shared.filter("many and node <> region").groupBy("region", "node").agg(
        F.max("own").alias("own")), "regions")
    pairs = _all_pivots(shared)
    pivots = stored(members.select("region", F.col("region").alias("pivot")).distinct(), "pivots")
    meetings = members.select("region", F.col("region").alias("pivot"), "node")
    links = None
    most, turn = PIVOTS, 0
    while True:
        asked = meetings.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"))
        found = compare.distances((asked if pairs is None else asked.unionByName(pairs)).distinct())
        pairs = None
        new = found.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        links = components(new if links is None else new.unionByName(
            links.select(F.col("node").alias("u"), F.col("root").alias("v"))))
        met = stored(meetings.withColumns({"a": F.least("pivot", "node"), "b": F.greatest("pivot", "node")}).join(
            found, ["a", "b"]).select("region", "pivot", "node", "distance", "linked"), "met")
        members = stored(_open(_split(met, members, pivots, links, turn)), "regions")
        if members.isEmpty():
            return links
        compare.narrow(members)
        turn += 1
        pivots = stored(_pivots(members, most, turn), "pivots")
        meetings = stored(_meetings(members, pivots), "meetings")
        members = members.select("region", "node", "own")
        most *= MORE


def link_groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id
    reachable by links of at least ``percent`` hundredths), node."""
    rows = stored(profiles(docs, k, percent), "shingle-profiles")
    held = rows.filter("node is not null")
    nodes = stored(held.groupBy("node").agg(
        F.first("n").alias("n"), F.first("text_hash").alias("text_hash"), F.first("hist").alias("hist"),
        F.min("doc_id").alias("least")), "shingle-nodes")
    tree = link_tree(docs, held, nodes.drop("least"), k, percent)
    rooted = nodes.select("node", "least").join(
        tree.select(F.col("node").alias("of"), "root"), F.col("node") == F.col("of"), "left").select(
        "node", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("node", "root").join(least, "root").select("node", "component_id")
    return rows.select("doc_id", "n", "node").join(named, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "node")
