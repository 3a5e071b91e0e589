"""Exact dedup by skew-safe combining (operator 5).

Texts are equal when identical after lower-casing A-Z only.  Copies are
combined in three steps, each comparing whole texts, not only digests:

1. locally: rows of a task share their salt, so Spark's map-side aggregation
   combines all copies inside the task;
2. per (digest, salt, text): a group holding a third of all rows is merged by
   ``salts`` tasks instead of one;
3. per (digest, text): at most ``salts`` salt winners meet for each text.

A digest that only one text has (step 3 has compared them) identifies that
text, so documents are joined to their group by the digest alone and texts
are not shuffled again.  Texts that share a digest are joined by digest and
text.

Defined results: a NULL text counts as empty; an empty table gives no rows;
NULL ids lose against any id, and a group of NULL ids only has a NULL
``keep_id``.  Rows that repeat the winning id are all reported as kept by
:func:`exact_groups`, and :func:`keep_latest` returns one of them.  Other
columns of the table take no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrate.llm.common import LOWER, UPPER, free_name, one_each, stored, text_or_empty


def _sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 salts: int = 64, digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """One row per document: doc_id, keep_id (largest id of its group),
    group_size, kept, digest."""
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       F.translate(text_or_empty(text_col), UPPER, LOWER).alias("body"))
    rows = rows.withColumn("digest", digest(F.col("body")))
    salted = (rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
              .groupBy("digest", "salt", "body")
              .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    # Dealt by digest, so both aggregates below share one shuffle.
    texts = (salted.repartition("digest").groupBy("digest", "body")
             .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    groups = stored(
        texts.groupBy("digest").agg(
            F.count(F.lit(1)).alias("n_texts"), F.max("keep_id").alias("keep_id"),
            F.max("group_size").alias("group_size")), "exact-groups")

    narrow = rows.select("doc_id", "digest")
    out = narrow.join(groups.filter("n_texts = 1").drop("n_texts"), "digest")
    shared = groups.filter("n_texts > 1").select("digest")
    if not shared.isEmpty():  # different texts with one digest
        both = rows.join(shared, "digest", "left_semi")
        mine = both.groupBy("digest", "body").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        out = out.unionByName(both.join(mine, ["digest", "body"]).drop("body"))
    return out.select("doc_id", "keep_id", "group_size",
                      F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def keep_latest(docs: DataFrame, salts: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the largest id, once."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    names = [free_name(docs.columns, "__id"), free_name(docs.columns, "__digest")]
    kept = exact_groups(docs, salts=salts).filter("kept").select(
        key.alias(names[0]), F.col("digest").alias(names[1]), F.lit(1).alias("n"))
    body = F.translate(text_or_empty(), UPPER, LOWER)
    named = docs.withColumns({names[0]: key, names[1]: F.sha2(body, 256)})
    return one_each(named, kept, names).select(*docs.columns)
