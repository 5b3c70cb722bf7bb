"""Run registered Spark queries next to their DuckDB oracle SQL and compare
row count, column names and an order-insensitive value digest.

    python tests/oracle_check.py [sf_dir] [key ...]
"""
from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True))
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    canon = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(canon).encode()).hexdigest()[:16], canon


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def main(argv):
    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in argv if not a.startswith("/")]
    import __spark_entry__ as E
    from kitman.session import local_session
    spark = local_session(8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    ok = bad = 0
    for k in (keys or list(sqls)):
        t = time.time()
        try:
            sdf = qs[k](spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
            rel = con.sql(sqls[k])
            dcols = list(rel.columns)
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{k:28s} ERROR {type(e).__name__}: {str(e)[:600]}")
            bad += 1
            continue
        hs, cs = digest(scols, srows)
        hd, cd = digest(dcols, drows)
        same = sorted(scols) == sorted(dcols) and len(srows) == len(drows) and hs == hd
        ok += same
        bad += not same
        print(f"{k:28s} {'OK ' if same else 'BAD'} rows={len(srows)}/{len(drows)} {time.time()-t:5.1f}s"
              + ("" if sorted(scols) == sorted(dcols) else f" cols {scols} vs {dcols}"))
        if not same and sorted(scols) == sorted(dcols):
            only_s = [x for x in cs if x not in set(cd)][:3]
            only_d = [x for x in cd if x not in set(cs)][:3]
            print("    spark-only:", [x[:300] for x in only_s])
            print("    duck-only: ", [x[:300] for x in only_d])
    print(f"{ok} ok, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
