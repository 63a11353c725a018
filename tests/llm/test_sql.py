"""Queries of the subpackage that have SQL, against DuckDB; the others run."""

import duckdb
import pytest

from weft.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = QUERIES[name](spark, data)
    cur = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert names == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_whole_tables(spark, data, name):
    source = {"op4": "conversations", "op9": "pages"}.get(name.split("_")[0], "documents")
    got, table = QUERIES[name](spark, data), spark.read.parquet(f"{data}/{source}.parquet")
    n = table.select("conv_id").distinct().count() + 1 if source == "conversations" else table.count()
    key = {"conversations": "conv_id", "pages": "page_id"}.get(source, "doc_id")
    assert got.select(key).distinct().count() == n
