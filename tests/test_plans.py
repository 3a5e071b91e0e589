"""Physical-plan checks: pushdown, pruning, no Python UDFs, bounded broadcasts."""

from __future__ import annotations

import __spark_entry__ as E
from millrate.plans import monthly


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_udf_in_any_batch_plan(spark, ledger):
    for name in E.LEDGER_QUERIES:
        fn = E.queries()[name]
        plan = _plan(fn(spark, ledger.sf_dir))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_month_report_prunes_partitions_and_pushes_filters(spark, ledger):
    d = monthly.monthly_detail(ledger.journal, ledger.parcels, 4, 1998)
    plan = _plan(d)
    assert "PartitionFilters: [isnotnull(receipt_month" in plan
    assert "receipt_month#" in plan and "1998-04-01" in plan
    assert "PushedFilters: [IsNotNull(date_received), GreaterThanOrEqual(date_received" in plan


def test_scans_read_only_needed_columns(spark, ledger):
    plan = _plan(E.queries()["status_by_tax_type"](spark, ledger.sf_dir))
    journal_schema = [ln for ln in plan.splitlines() if "ReadSchema" in ln and "transaction_type" in ln]
    assert journal_schema, plan
    assert all("notes" not in ln and "image_path" not in ln for ln in journal_schema)


def test_whole_stage_codegen_present(spark, ledger):
    df = E.queries()["validate_payments"](spark, ledger.sf_dir)
    df.collect()  # AQE shows the final plan with codegen stages after execution
    plan = _plan(df)
    assert "isFinalPlan=true" in plan and "*(" in plan
