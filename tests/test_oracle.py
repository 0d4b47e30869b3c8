"""Every registered query that has a SQL twin gives DuckDB's rows."""

import math

import duckdb
import pytest

import __spark_entry__
from loomstead.plans import star
from loomstead.session import TABLES

QUERIES = {name: query for plan in __spark_entry__.PLANS for name, query in plan.QUERIES.items()}
SQL = {name: sql for plan in __spark_entry__.PLANS for name, sql in plan.SQL.items()}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(rows, names):
    """Rows as sorted tuples with columns in name order and floats to nine digits."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: float(f"{v:.9g}") if isinstance(v, float) and math.isfinite(v) else v
    return sorted([names[i] for i in order]), sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(name, spark, duck, sf_dir):
    frame = QUERIES[name](spark, sf_dir)
    got = plain([tuple(r) for r in frame.collect()], frame.columns)
    found = duck.execute(SQL[name])
    want = plain(found.fetchall(), [d[0] for d in found.description])
    assert got == want
    assert want[1]


def test_queries_without_sql_have_rows(spark, sf_dir):
    for name in QUERIES.keys() - SQL.keys():
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_approximate_counts_are_near(spark, sf_dir):
    exact = {tuple(r)[0]: tuple(r)[1] for r in star.distinct_buyers(spark, sf_dir).collect()}
    near = {tuple(r)[0]: tuple(r)[1] for r in star.approximate_buyers(spark, sf_dir).collect()}
    assert exact.keys() == near.keys()
    assert all(abs(near[k] - exact[k]) <= 3 * 0.02 * exact[k] for k in exact)


def test_entry_has_every_query(spark):
    assert __spark_entry__.queries().keys() >= QUERIES.keys()
    assert __spark_entry__.oracle_sql().keys() >= SQL.keys()
    assert __spark_entry__.entry(spark).count() == 5
