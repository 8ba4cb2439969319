"""The corpus queries that have SQL, against it."""

import duckdb
import pytest

from orbitframe.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    df = QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    got = sorted(tuple(r[c] for c in names) for r in df.collect())
    cur = con.execute(ORACLES[name])
    theirs = [x[0] for x in cur.description]
    assert sorted(theirs) == names
    assert got == sorted(tuple(r[theirs.index(c)] for c in names) for r in cur.fetchall())
    assert got
