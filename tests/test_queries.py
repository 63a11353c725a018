"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from weft.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(row):
    return tuple(round(float(v), 6) + 0.0 if isinstance(v, float) else v for v in row)


def order(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    got = sorted((plain(r) for r in df.select(*sorted(df.columns)).collect()), key=order)
    con = duck.execute(SQL[name])
    names = [c[0] for c in con.description]
    assert sorted(df.columns) == sorted(names)
    at = [names.index(c) for c in sorted(names)]
    want = sorted((plain(tuple(r[i] for i in at)) for r in con.fetchall()), key=order)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6)) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).collect()
