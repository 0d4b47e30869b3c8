"""Corpus queries that have a SQL twin give DuckDB's rows."""

import duckdb
import pytest

from loomstead.llm import queries, twins


@pytest.mark.parametrize("name", sorted(twins.SQL))
def test_query_equals_its_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found = con.execute(twins.SQL[name])
    columns = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=repr)
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=repr) == want and want
