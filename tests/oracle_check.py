"""Run registered queries in Spark and their oracle SQL in DuckDB; compare like the driver.

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from lectern.sources.catalogue import DRIVER_TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def duck(sf_dir):
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    from lectern.session import get_session
    spark = get_session("local[8]", 8)
    qs, oracle = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as exc:  # noqa: BLE001
            print(f"{name:32s} SPARK-ERROR {str(exc).splitlines()[0][:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in oracle:
            print(f"{name:32s} rows={len(rows):7d} (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(oracle[name])
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as exc:  # noqa: BLE001
            print(f"{name:32s} SQL-ERROR {str(exc).splitlines()[0][:300]}")
            bad += 1
            continue
        same_cols = sorted(cols) == sorted(ocols)
        same = same_cols and digest(cols, rows) == digest(ocols, orows)
        status = "OK" if same and len(rows) == len(orows) else "MISMATCH"
        if status != "OK":
            bad += 1
        print(f"{name:32s} {status} rows={len(rows)} oracle={len(orows)} cols_ok={same_cols} {ts:.1f}s")
        if status != "OK" and same_cols:
            order = sorted(range(len(cols)), key=lambda i: cols[i])
            oorder = sorted(range(len(ocols)), key=lambda i: ocols[i])
            a = {repr(tuple(_norm(r[i]) for i in order)) for r in rows}
            b = {repr(tuple(_norm(r[i]) for i in oorder)) for r in orows}
            print("   cols:", sorted(cols))
            print("   spark-only:", list(a - b)[:3])
            print("   oracle-only:", list(b - a)[:3])
        elif not same_cols:
            print("   spark cols:", cols, "\n   oracle cols:", ocols)
    print("failures:", bad)


if __name__ == "__main__":
    main()
