"""Every query of the package against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from orbitframe.plans import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else v


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    cur = con.execute(ORACLES[name])
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == names
    want = sorted((tuple(plain(r[theirs.index(c)]) for c in names) for r in cur.fetchall()), key=str)
    assert got == want
    assert want
