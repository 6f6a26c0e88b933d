"""Every registered core query runs; those with SQL agree with it on the smallest tables."""

import math
import os

import duckdb
import pytest

import lodestack.plans.registry as registry

ORACLE = registry.oracle_sql()


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{small}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, small, duck, name):
    df = registry.queries()[name](spark, small)
    cols = sorted(df.columns)
    rows = sorted(tuple(canon(x) for x in r) for r in df.select(*cols).collect())
    if name not in ORACLE:
        assert df.columns
        return
    r = duck.execute(ORACLE[name])
    names = [d[0] for d in r.description]
    want = sorted(tuple(canon(row[names.index(c)]) for c in cols) for row in r.fetchall())
    assert sorted(names) == cols and rows == want


def test_entry_points():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50
