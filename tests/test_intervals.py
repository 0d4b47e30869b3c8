"""Interval joins against a nested loop over small tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomstead.operators.intervals import interval_join

SCHEMA = "k string, i long, s long, e long"


def intervals(rng, n, longest):
    rows = []
    for i in range(n):
        start = rng.randrange(-500, 500)
        rows.append((rng.choice("ab"), i, start, start + rng.choice([0, 1, 2, 5, rng.randrange(1, longest), -3])))
    return rows + [(None, n, 0, 10), ("a", n + 1, None, 10), ("a", n + 2, 0, None), rows[0]]


def overlapping(left, right, keyed=True):
    ok = lambda r: r[0] is not None and r[2] is not None and r[3] is not None and r[2] < r[3]
    return sorted((a[1], b[1]) for a in left for b in right if ok(a) and ok(b) and (a[0] == b[0] or not keyed) and a[2] < b[3] and b[2] < a[3])


@pytest.mark.parametrize(("width", "longest", "heavy"), [(1, 20, 50_000), (4, 900, 50_000), (4, 900, 3), (1000, 5, 2), (7, 60, 10)])
def test_every_overlap_once(spark, width, longest, heavy):
    rng = random.Random(width * 1000 + longest)
    left, right = intervals(rng, 90, longest), intervals(rng, 120, 2000 if longest == 20 else longest)
    a, b = spark.createDataFrame(left, SCHEMA).repartition(3), spark.createDataFrame(right, SCHEMA).repartition(4)
    got = interval_join(a, b, ("s", "e"), ("s", "e"), width, ("k",), heavy=heavy)
    assert sorted((r.i, r.right_i) for r in got.collect()) == overlapping(left, right)


def test_without_keys_and_with_clashing_names(spark):
    rng = random.Random(1)
    left, right = [r for r in intervals(rng, 40, 30) if r[0]], [r for r in intervals(rng, 40, 30) if r[0]]
    clash = {c: F.lit("x") for c in ("left", "right", "level", "bin", "at", "first", "split", "start", "end")}
    a, b = (spark.createDataFrame(rows, SCHEMA).withColumns(clash) for rows in (left, right))
    got = interval_join(a, b, ("s", "e"), ("s", "e"), 3)
    assert sorted((r.i, r.right_i) for r in got.collect()) == overlapping(left, right, keyed=False)
    assert {"left", "right_level"} <= set(got.columns)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_times_and_dates(spark, kind):
    day = lambda n: datetime(1969, 12, 20) + timedelta(days=n)
    rows = [("a", i, day(i), day(i + 1 + i % 5)) for i in range(30)]
    frame = spark.createDataFrame(rows, "k string, i long, s timestamp, e timestamp").withColumns({c: F.col(c).cast(kind) for c in "se"})
    got = interval_join(frame, frame, ("s", "e"), ("s", "e"), 1 if kind == "date" else 86_400_000_000, ("k",))
    assert sorted((r.i, r.right_i) for r in got.collect()) == overlapping(rows, rows)


def test_empty_tables_and_refusals(spark):
    some, none = spark.createDataFrame([("a", 1, 0, 5)], SCHEMA), spark.createDataFrame([], SCHEMA)
    assert interval_join(some, none, ("s", "e"), ("s", "e"), 5).collect() == []
    assert interval_join(none, some, ("s", "e"), ("s", "e"), 5, ("k",)).collect() == []
    with pytest.raises(ValueError):
        interval_join(some, some, ("s", "k"), ("s", "e"), 5)
    with pytest.raises(ValueError):
        interval_join(some, some, ("s", "e"), ("s", "e"), 0)


def test_the_plan_has_no_nested_loop(spark):
    frame = spark.createDataFrame(intervals(random.Random(2), 50, 40), SCHEMA)
    plan = interval_join(frame, frame, ("s", "e"), ("s", "e"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
