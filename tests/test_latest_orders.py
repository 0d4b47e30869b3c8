"""Latest orders of odd tables, held against the query's SQL."""

import random
import re
from datetime import datetime, timedelta

import duckdb
import pytest

from loomstead.plans import star


@pytest.fixture(scope="module")
def odd_orders(spark, tmp_path_factory):
    """Orders in many files and any order: equal days, null days and keys, customers that occur twice, not at all, or are null."""
    folder, rng = tmp_path_factory.mktemp("orders"), random.Random(3)
    spark.createDataFrame([(i,) for i in [*range(40), 1, 2, None]], "c_custkey long").write.parquet(f"{folder}/customer.parquet")
    day = lambda: rng.choice([None, datetime(2000, 1, 1) + timedelta(days=rng.randrange(5))])
    rows = [(i, rng.choice([None, *range(45)]), float(i), day()) for i in range(2000)] + [(None, i, -1.0, datetime(2000, 1, 5)) for i in range(45)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz")
    frame.repartition(16).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_latest_orders_of_odd_tables(spark, odd_orders):
    con = duckdb.connect()
    for name in ("customer", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{odd_orders}/{name}.parquet/*.parquet'")
    got = [tuple(r) for r in star.latest_orders(spark, odd_orders).collect()]
    want = con.execute(star.SQL["latest_orders"]).fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len(want) == 80


def test_orders_are_sorted_after_the_shuffle(spark, sf_dir):
    """Rows of a shuffle come in any order, so the window itself has to sort them by day and key."""
    plan = star.latest_orders(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for window in re.findall(r"Window \[row_number\(\) windowspecdefinition\((.*?)specifiedwindowframe", plan):
        assert "o_orderdate" in window and "o_orderkey" in window
    assert "row_number()" in plan
