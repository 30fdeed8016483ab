"""Every query with oracle SQL: Spark result == DuckDB result (sf0.001, tolerant
on doubles), the driver's correctness gate in miniature."""

import json
import math

import duckdb
import numpy as np
import pytest

from terrapulse.plans.catalog import load_all, oracles
from terrapulse.sources.tables import TABLES

REG = load_all()
SQL_QUERIES = sorted(n for n, e in REG.items() if e.sql)


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "asDict"):
        return {k: _norm(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: _norm(x) for k, x in v.items()}
    if isinstance(v, (list, tuple, np.ndarray)):
        return [_norm(x) for x in v]
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return float(f"{float(v):.9g}")
    except ImportError:
        pass
    return v


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_matches_oracle(spark, duck, small_dir, name):
    e = REG[name]
    sdf = e.fn(spark, small_dir)
    cols = sorted(sdf.columns)
    rel = duck.sql(oracles(spark)[name])
    assert sorted(rel.columns) == cols
    s_rows = sorted(json.dumps([_norm(r[c]) for c in cols], default=str) for r in sdf.collect())
    d_rows = sorted(json.dumps([_norm(dict(zip(rel.columns, r))[c]) for c in cols], default=str)
                    for r in rel.fetchall())
    assert len(s_rows) == len(d_rows)
    assert s_rows == d_rows
