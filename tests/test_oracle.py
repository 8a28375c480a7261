"""Every engine query against its SQL, on the smallest tables."""

import duckdb
import pytest

from ferrule import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in Q.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(name, spark, duck):
    df = Q.queries()[name](spark, SF)
    want = duck.sql(Q.oracle_sql()[name])
    order = [want.columns.index(c) for c in sorted(df.columns)]
    got = sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())
    assert got == sorted(repr([r[i] for i in order]) for r in want.fetchall())
