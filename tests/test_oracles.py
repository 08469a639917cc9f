"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from spanwise.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    cur = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    assert got == want
