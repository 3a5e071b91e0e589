"""The corpus queries that SQL can express, against DuckDB."""

from __future__ import annotations

import pytest
from oracle_check import compare

from millrate.llm import registry


@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_query_matches_oracle(spark, key):
    res = compare(spark, "/root/testdata/sf0.001", [key], verbose=False)[key]
    assert "error" not in res and res["columns_match"] and res["hash_match"], res
    assert res["spark_rows"] == res["oracle_rows"], res
