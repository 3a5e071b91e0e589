"""millrate: a property-tax billing and collection ledger on Spark.

The roll of billable parcels and the journal of payment attempts are plain
DataFrames; every rule (pricing by postmark date, validation, status, month
locks, reports) is a composition of built-in Spark SQL functions, joins,
aggregates and windows, so Catalyst can push filters into Parquet scans and
keep the work inside whole-stage code generation.
"""

from millrate.session import build_session, scratch_path

__all__ = ["build_session", "scratch_path"]
