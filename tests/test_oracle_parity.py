"""Every registered query against its DuckDB oracle on the smallest tables,
plus the stream = batch property."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from oracle_check import compare

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"receipt_month", "tax_type", "payment_period", "amount"}


@pytest.mark.parametrize("key", sorted(E.LEDGER_QUERIES))
def test_query_matches_oracle(spark, ledger, key):
    res = compare(spark, SF, [key], verbose=False)[key]
    assert "error" not in res, res
    assert res["columns_match"], res
    assert res["spark_rows"] == res["oracle_rows"], res
    assert res["hash_match"], res


def test_every_ledger_query_has_an_oracle():
    assert not set(E.LEDGER_QUERIES) - set(E.oracle_sql())


def test_stream_equals_batch(spark, ledger):
    qs = E.queries()
    stream_rows = qs["stream_payments"](spark, SF)
    batch_rows = qs["post_payments"](spark, SF)
    others = qs["stream_refused"](spark, SF).count() + qs["stream_unknown"](spark, SF).count()
    assert stream_rows.count() + others == batch_rows.count()
    assert stream_rows.exceptAll(batch_rows).count() == 0
