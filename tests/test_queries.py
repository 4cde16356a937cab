"""Every query that has SQL gives what DuckDB gives on the same tables."""

import glob
import os

import duckdb
import pytest

from fathomline.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def _value(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(_value(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(_value(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want and got


def test_every_query_is_registered():
    assert set(registry.ORACLE_SQL) == set(registry.QUERIES)
    assert len(registry.QUERIES) == 74
