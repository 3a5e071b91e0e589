"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrate.session import scratch_path

# The letters that ASCII lower-casing changes.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Most labels that a classifier is fitted for; bounds what is broadcast.
MAX_LABELS = 10_000

#: Most rows of keys that Spark may broadcast.  It goes by a table's compressed files;
#: the hash table on the driver takes 100 to 250 bytes a row.
MAX_BROADCAST = 100_000


def free_name(taken: list[str], name: str) -> str:
    """``name``, lengthened until no column in ``taken`` has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds`` (NULL id: of '')."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read again:
    later readers neither recompute it nor depend on one executor's disk."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_each(rows: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose ``keys`` are in ``kept`` (keys, n: how many rows have them),
    one row for each.  Only rows of keys that several have are compared, so the
    others' texts are neither sorted nor, while ``kept`` is small enough to broadcast,
    shuffled."""
    kept = stored(kept.groupBy(*keys).agg(F.sum("n").alias("n")), "kept-keys")
    if kept.count() > MAX_BROADCAST:
        kept = kept.hint("merge")
    once = rows.join(kept.filter("n = 1").select(*keys), keys, "left_semi")
    several = kept.filter("n > 1").select(*keys)
    if several.isEmpty():
        return once
    return once.unionByName(rows.join(several, keys, "left_semi").dropDuplicates(keys))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text",
           max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about ``max_bytes`` of text (one
    longer text makes a batch of its own): bounds a task's Python memory."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, size = 0, 0
        for i, n in enumerate(sizes):
            if i > start and size + n > max_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


def bounded_sample(rows: DataFrame, by: str, most: int) -> DataFrame:
    """At most ``most`` rows for each value of ``by``, those with the smallest
    hash of ``doc_id``.  A threshold from the counts cuts the rows first, so the
    ranking only ever sees a small multiple of ``most`` rows per value (of equal
    ids beyond that, Spark's limit inside each task keeps ``most``)."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    counts = stored(rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")), "label-counts")
    if counts.count() > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} different labels")
    limits = counts.select(F.col(by).alias("__by"), (
        F.lit((2.0 * most + 50.0) * (1 << 30)) / F.col("n")).alias("__limit"))
    # A row per label, so rows are cut where they are read, without a shuffle.
    near = rows.withColumn("__place", place).join(
        F.broadcast(limits), F.col(by) == F.col("__by")).filter("__place <= __limit")
    order = Window.partitionBy("__by").orderBy("__place", "doc_id")
    return (near.withColumn("__rank", F.row_number().over(order))
            .filter(F.col("__rank") <= most).select(*rows.columns))


def labelled_texts(docs: DataFrame, labels: DataFrame, by: str, most: int) -> DataFrame:
    """(doc_id, ``by``, text) of a bounded sample of ``labels`` (doc_id, ``by``).

    Ids are sampled first, so texts are only read, not shuffled, to find the
    sample's; a repeated id gives its smallest text.  NULL ids and labels, and
    ids without a text, take no part.
    """
    known = labels.select("doc_id", by).filter(F.col("doc_id").isNotNull() & F.col(by).isNotNull())
    ids = stored(bounded_sample(known, by, most), "label-sample")  # most rows per label
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", by).agg(F.min("text").alias("text"))
