"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

usage: python tools/oracle_check.py [sf_dir] [name ...]

Reports per query: row counts, column names, exact value match and a
tolerant match (doubles to 9 significant digits).
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402

from terrapulse.plans.catalog import load_all, oracles  # noqa: E402
from terrapulse.session import build_session  # noqa: E402
from terrapulse.sources.tables import TABLES  # noqa: E402


def norm(v, digits):
    if v is None:
        return None
    if hasattr(v, "asDict"):
        return {k: norm(x, digits) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: norm(x, digits) for k, x in v.items()}
    if isinstance(v, (list, tuple, np.ndarray)):
        return [norm(x, digits) for x in v]
    if isinstance(v, (np.floating, float)):
        f = float(v)
        if math.isnan(f):
            return None
        if digits is None:
            return repr(f)
        return float(f"{f:.{digits}g}")
    if isinstance(v, decimal.Decimal):
        return norm(float(v), digits)
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, bool) or isinstance(v, np.bool_):
        return bool(v)
    return v


def rows_of(records, cols, digits):
    out = [json.dumps([norm(r[c], digits) for c in cols], sort_keys=True, default=str) for r in records]
    return sorted(out)


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = build_session("local[8]", 8)
    reg, sql = load_all(), oracles(spark)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    todo = names or list(reg)
    summary = {}
    for name in todo:
        e = reg[name]
        t0 = time.time()
        try:
            sdf = e.fn(spark, sf_dir)
            srows = [r.asDict(recursive=False) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as exc:  # noqa: BLE001
            summary[name] = f"SPARK ERROR {type(exc).__name__}: {str(exc)[:300]}"
            print(name, summary[name], flush=True)
            continue
        ts = time.time() - t0
        if name not in sql:
            summary[name] = f"rows-only: {len(srows)} rows ({ts:.1f}s)"
            print(name, summary[name], flush=True)
            continue
        try:
            rel = con.sql(sql[name])
            dcols = rel.columns
            drows = [dict(zip(dcols, r)) for r in rel.fetchall()]
        except Exception as exc:  # noqa: BLE001
            summary[name] = f"DUCKDB ERROR {str(exc)[:300]}"
            print(name, summary[name], flush=True)
            continue
        if sorted(scols) != sorted(dcols):
            summary[name] = f"COLUMNS differ spark={sorted(scols)} duck={sorted(dcols)}"
            print(name, summary[name], flush=True)
            continue
        cols = sorted(scols)
        exact = rows_of(srows, cols, None) == rows_of(drows, cols, None)
        a, b = rows_of(srows, cols, 9), rows_of(drows, cols, 9)
        tol = a == b
        status = "OK" if tol else "MISMATCH"
        summary[name] = f"{status} rows={len(srows)}/{len(drows)} exact={exact} ({ts:.1f}s)"
        print(name, summary[name], flush=True)
        if not tol:
            diff_a = [x for x in a if x not in set(b)][:3]
            diff_b = [x for x in b if x not in set(a)][:3]
            print("   spark-only:", [x[:400] for x in diff_a])
            print("   duck-only: ", [x[:400] for x in diff_b])
    bad = [n for n, s in summary.items() if not (s.startswith("OK") or s.startswith("rows-only"))]
    print(f"\n{len(summary) - len(bad)}/{len(summary)} fine; bad: {bad}")
    spark.stop()


if __name__ == "__main__":
    main()
