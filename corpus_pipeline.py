"""The corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame, which is written as Parquet under the shared folder and
read again as the next one's docs.  All but the last return the columns of docs.

1. language_id: documents that the nearest-centroid classifier rejects go.
2. exact_dedup: of equal texts the row with the largest id stays.
3. simhash: of each near-duplicate group the row with the smallest id stays.
4. mixing: rows are repeated or left out by their rate for the target weights.
5. byte_bpe: doc_id, n_tokens and ids of every row.

Empty tables pass through all stages as empty tables; further columns of
documents pass through the first four.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrate.llm import byte_bpe, exact_dedup, language_id, production, simhash
from millrate.llm.common import read, stored


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    said = language_id.predict(docs, production.language_model(docs), docs.columns)
    rejected = said.columns[-1]
    return said.filter(~said[rejected]).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_latest(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return production.mixture(spark, docs, sf_dir).drawn()


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(docs, production.BYTE_BPE, public_tokenizers.PATTERN)


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: SQL has no classifier, SimHash or BPE; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
