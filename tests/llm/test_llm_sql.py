"""The queries that SQL can express against DuckDB."""

import pytest

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    return f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df, rel = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
