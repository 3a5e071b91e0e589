"""Check extractions (S3): model-produced JSON text about a check.

Code fences are stripped with a regular expression and the text is parsed
with ``from_json`` against a fixed schema; malformed text, an amount that is no
money and a date that is no date yield a row flagged ``parse_ok = false``
instead of failing the job.

The cleaned text, the parsed struct, its date and amount, the parse flag and the
parcel id are each produced by a one-row ``inline`` generator.  Catalyst does
not inline generator output into later expressions, so filters and field
accesses downstream read the columns instead of re-running the regexes, the
JSON parser and the date parser once per reference.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrate.functions import text
from millrate.schemas import CHECK_EXTRACTION, MONEY


def _once(df: DataFrame, expr: Column, name: str) -> DataFrame:
    """Append ``expr`` as column ``name``, evaluated exactly once per row."""
    return df.select("*", F.inline(F.array(F.struct(expr.alias(name)))))


def parse_check_extractions(df: DataFrame, text_col: str = "raw_text",
                            as_of: _dt.date | None = None) -> DataFrame:
    """Parsed fields, a parse flag and the parcel id found in the memo.

    A missing ``postmark_date`` means "today" for the model, so it becomes
    ``as_of`` when given, and stays NULL otherwise.
    """
    keep = [c for c in df.columns if c != text_col]
    unfenced = F.replace(F.replace(F.col(text_col), F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    staged = _once(df, F.regexp_replace(unfenced, r"^\s+|\s+$", ""), "_clean")
    staged = _once(staged, F.from_json("_clean", CHECK_EXTRACTION, {"mode": "PERMISSIVE"}), "_p")
    staged = _once(staged, F.struct(
        F.try_to_date(F.col("_p.postmark_date"), "yyyy-MM-dd").alias("dated"),
        F.col("_p.amount").try_cast(MONEY).alias("amount")), "_typed")
    cleaned, dated = F.col("_clean"), F.col("_typed.dated")
    # from_json stops behind the first value; what follows it breaks an object around it,
    # and a comma gives an array around it a second entry.
    one = (F.from_json(F.concat(F.lit('{"v":'), "_clean", F.lit("}")), "v string")["v"].isNotNull()
           & (F.size(F.from_json(F.concat(F.lit("["), "_clean", F.lit("]")), "array<string>")) == 1))
    ok = (F.col("_p").isNotNull() & cleaned.startswith("{") & cleaned.endswith("}")
          & F.col("_typed.amount").isNotNull()
          & (F.col("_p.postmark_date").isNull() | dated.isNotNull()) & one)
    staged = _once(staged, F.coalesce(ok, F.lit(False)), "_ok")
    ok = F.col("_ok")
    pm = dated if as_of is None else F.coalesce(dated, F.lit(as_of))
    memo = F.when(ok, F.col("_p.memo"))
    staged = _once(staged, F.when(ok, text.parcel_from_memo(memo)), "_found")
    return staged.select(
        *keep,
        F.when(ok, F.col("_p.check_number")).alias("check_number"),
        F.when(ok, F.col("_typed.amount")).alias("amount"),
        F.when(ok, pm).alias("postmark_date"),
        F.when(ok, F.col("_p.payer_name")).alias("payer_name"),
        F.when(ok, F.col("_p.payer_address")).alias("payer_address"),
        memo.alias("memo"),
        ok.alias("parse_ok"),
        F.col("_found").alias("found_parcel_id"),
    )
