"""Places and running sums over a global order, against plain Python."""

import random
from decimal import Decimal
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from loomstead.operators.running import number_rows, running_sum


def test_places_follow_the_order(spark):
    rng = random.Random(3)
    keys = [None, 5, 5, 5] + [rng.randrange(1000) for _ in range(500)]
    frame = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, place long").repartition(7)
    got = number_rows(frame, [F.desc_nulls_last("k"), F.col("place")], "nth", parts=9).collect()
    want = sorted(enumerate(keys), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [r.place for r in sorted(got, key=lambda r: r.nth)] == [i for i, _ in want]
    assert sorted(r.nth for r in got) == list(range(len(keys)))


def test_a_hot_key_is_dealt_by_the_last_expression(spark):
    frame = spark.range(20_000).select(F.lit(1).alias("k"), "id")
    found = number_rows(frame, [F.col("k"), F.col("id")], parts=8)
    assert found.where("place = id").count() == 20_000
    assert found.groupBy(F.spark_partition_id()).count().count() > 4


@pytest.mark.parametrize("kind", ["long", "decimal(12,2)", "double"])
def test_running_sums(spark, kind):
    rows = [(i, None if i % 7 == 0 else (i * 37) % 101 - 50) for i in range(300)]
    frame = spark.createDataFrame(rows, "i int, v int").withColumn("v", F.col("v").cast(kind)).repartition(5)
    got = {r.i: r.running for r in running_sum(frame, [F.desc("i")], "v", parts=6).collect()}
    sums = accumulate(v or 0 for _, v in reversed(rows))
    assert got == {i: Decimal(s) if "decimal" in kind else s for (i, _), s in zip(reversed(rows), sums, strict=True)}


def test_running_sum_may_replace_its_value_and_empty_tables_stay_empty(spark):
    frame = spark.createDataFrame([(1, 2), (2, 3)], "__at int, v long")
    assert sorted(tuple(r) for r in running_sum(frame, [F.col("__at")], "v", "v").collect()) == [(1, 2), (2, 5)]
    assert number_rows(frame.limit(0), [F.col("v")]).collect() == []
    assert running_sum(frame.limit(0), [F.col("v")], "v").collect() == []


def test_no_task_gets_all_rows(spark):
    plan = running_sum(spark.range(100), [F.col("id")], "id")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
