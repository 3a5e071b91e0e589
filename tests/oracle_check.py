"""Run registered queries on Spark and their oracle SQL on DuckDB; compare
row count, column names and an order-insensitive hash of the values.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
ROOT = os.path.dirname(HERE)
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int,)):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return repr(float(v))
    if isinstance(v, _dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, _dt.date):
        return v.isoformat()
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256()
    for line in lines:
        h.update(line.encode())
        h.update(b"\n")
    return h.hexdigest(), lines


def duck_connect(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir, keys=None, verbose=True):
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    con = duck_connect(sf_dir)
    results = {}
    for key in keys or list(qs):
        t0 = time.time()
        rec = {"oracle": key in sql}
        try:
            df = qs[key](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
            rec["spark_rows"] = len(srows)
            if key in sql:
                cur = con.execute(sql[key])
                dcols = [d[0] for d in cur.description]
                drows = cur.fetchall()
                rec["oracle_rows"] = len(drows)
                rec["columns_match"] = sorted(scols) == sorted(dcols)
                hs, ls = digest(scols, srows)
                hd, ld = digest(dcols, drows)
                rec["hash_match"] = hs == hd
                if not rec["columns_match"]:
                    rec["spark_cols"] = sorted(set(scols) - set(dcols))
                    rec["oracle_cols"] = sorted(set(dcols) - set(scols))
                elif hs != hd:
                    only_s = sorted(set(ls) - set(ld))[:2]
                    only_d = sorted(set(ld) - set(ls))[:2]
                    rec["sample_spark"] = only_s
                    rec["sample_oracle"] = only_d
        except Exception as e:  # noqa: BLE001
            rec["error"] = f"{type(e).__name__}: {str(e)[:400]}"
        rec["sec"] = round(time.time() - t0, 2)
        results[key] = rec
        if verbose:
            ok = rec.get("hash_match") and rec.get("columns_match") and \
                rec.get("spark_rows") == rec.get("oracle_rows")
            status = "OK " if ok else ("---" if not rec["oracle"] and "error" not in rec else "BAD")
            print(status, key, json.dumps({k: v for k, v in rec.items() if k != "oracle"})[:900],
                  flush=True)
    return results


if __name__ == "__main__":
    from millrate.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    spark = build_session("local[8]")
    res = compare(spark, sf, keys)
    bad = [k for k, r in res.items() if r.get("oracle") and not (
        r.get("hash_match") and r.get("columns_match"))] + [k for k, r in res.items() if "error" in r]
    print("SUMMARY", len(res), "queries;", len(bad), "bad:", bad)
