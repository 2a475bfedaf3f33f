"""Run registered queries in Spark and their oracle SQL in DuckDB, then compare.

Comparison: row count, sorted column names, and an order-insensitive hash of the values
(floats rounded to 9 significant digits, NaN/None unified). Usage:

    python tests/oracle_harness.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        return float(f"{v:.9g}")
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if isinstance(v, (int, str)):
        return v
    try:
        return float(f"{float(v):.9g}")
    except (TypeError, ValueError):
        return str(v)


def digest(columns, rows) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return {"query": name, "rows": len(s_rows), "oracle": None, "spark_s": round(t1 - t0, 2)}
    rel = con.execute(sql)
    d_cols = [c[0] for c in rel.description]
    d_rows = rel.fetchall()
    t2 = time.time()
    res = {"query": name, "rows": len(s_rows), "oracle_rows": len(d_rows),
           "cols_ok": sorted(s_cols) == sorted(d_cols),
           "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2)}
    res["hash_ok"] = res["cols_ok"] and digest(s_cols, s_rows) == digest(d_cols, d_rows)
    if not res["cols_ok"]:
        res["spark_cols"], res["duck_cols"] = sorted(s_cols), sorted(d_cols)
    res["ok"] = res["hash_ok"] and len(s_rows) == len(d_rows)
    if not res["ok"] and res["cols_ok"]:
        so = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
        do = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
        a = sorted(repr(tuple(_norm(r[i]) for i in so)) for r in s_rows)
        b = sorted(repr(tuple(_norm(r[i]) for i in do)) for r in d_rows)
        only_s = sorted(set(a) - set(b))[:3]
        only_d = sorted(set(b) - set(a))[:3]
        res["sample_spark_only"], res["sample_duck_only"] = only_s, only_d
    return res


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from transitio.session import build_session

    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name in names or list(qs):
        try:
            r = compare(spark, con, name, qs[name], sqls.get(name), sf_dir)
        except Exception as exc:  # report and continue
            r = {"query": name, "error": f"{type(exc).__name__}: {str(exc)[:400]}"}
        ok = r.get("ok", r.get("oracle", 0) is None and "error" not in r)
        bad += not ok
        print(("OK   " if ok else "FAIL ") + repr(r), flush=True)
    print(f"{len(names or qs) - bad} ok, {bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
