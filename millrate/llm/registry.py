"""The corpus queries by name."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from millrate.llm import production as p


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p.op1_token_files, p.op2_byte_bpe, p.op3_simhash, p.op4_toxicity, p.op5_exact_dedup, p.op6_quality,
           p.op7_language_id, p.op8_mixing, p.op9_token_counts, p.op10_sharding, p.op11_hard_negatives,
           p.op12_jaccard_join, p.op13_filter_audit)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    sql = {"op5_exact_dedup": p.OP5_SQL, "op10_sharding": p.OP10_SQL, "op11_hard_negatives": p.OP11_SQL,
           "op12_jaccard_join": p.OP12_SQL, "op13_filter_audit": p.OP13_SQL}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
