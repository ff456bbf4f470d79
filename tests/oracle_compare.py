"""Run registered queries on Spark and their SQL oracles on DuckDB; compare.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Prints one line per query: name, status, rows (spark/oracle), seconds.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def oracle_con(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = oracle_con(sf_dir)
    out = {}
    for name in names or qs:
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            scols = df.columns
            srows = [tuple(r) for r in df.collect()]
            st = time.time() - t0
        except Exception as e:  # noqa: BLE001
            out[name] = ("SPARK_ERROR", repr(e)[:400])
            if verbose:
                print(name, "SPARK_ERROR", repr(e)[:400], flush=True)
            continue
        if name not in sqls:
            out[name] = ("ROWS_ONLY", len(srows))
            if verbose:
                print(f"{name:28s} ROWS_ONLY rows={len(srows)} {st:.1f}s", flush=True)
            continue
        try:
            rel = con.execute(sqls[name])
            ocols = [d[0] for d in rel.description]
            orows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            out[name] = ("SQL_ERROR", repr(e)[:400])
            if verbose:
                print(name, "SQL_ERROR", repr(e)[:400], flush=True)
            continue
        ok_cols = sorted(scols) == sorted(ocols)
        a, b = _rows(scols, srows), _rows(ocols, orows)
        status = "MATCH" if ok_cols and a == b else "MISMATCH"
        out[name] = (status, len(srows), len(orows))
        if verbose:
            print(f"{name:28s} {status} rows={len(srows)}/{len(orows)} {st:.1f}s", flush=True)
            if status != "MATCH":
                print("   cols", sorted(scols), sorted(ocols))
                diff_a = [r for r in a if r not in set(b)][:3]
                diff_b = [r for r in b if r not in set(a)][:3]
                print("   spark-only", diff_a)
                print("   oracle-only", diff_b)
    return out


if __name__ == "__main__":
    from weftcore.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8)
    compare(spark, sf, sys.argv[2:] or None)
