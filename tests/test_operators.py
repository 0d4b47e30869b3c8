"""Operators, sources and functions on small hand-made tables."""

from collections import Counter
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from loomstead.functions import udfs
from loomstead.operators.asof import asof_join
from loomstead.sources import tables
from loomstead.streaming import event_stream

DAY = "date_trunc('day', __on)"


def rows(spark, values):
    return spark.createDataFrame(values, "k long, t string, v long").withColumn("t", F.col("t").cast("timestamp_ntz"))


def test_asof_takes_the_latest_row_not_after(spark):
    left = rows(spark, [(1, "2024-01-03 10:00:00", 1), (1, "2024-01-01 09:00:00", 2), (1, "2024-01-09 00:00:00", 3), (2, "2024-01-03 00:00:00", 4), (None, "2024-01-03 00:00:00", 5), (1, None, 6), (1, "2024-01-03 10:00:00", 1)])
    right = rows(spark, [(1, "2024-01-01 10:00:00", 10), (1, "2024-01-03 10:00:00", 20), (1, "2024-01-03 10:00:00", 21), (1, "2024-01-03 11:00:00", 30), (None, "2024-01-01 00:00:00", 40), (1, None, 50)])
    got = sorted((r.v, r.right_v) for r in asof_join(left, right, "t", "k", DAY).collect())
    assert got == [(1, 21), (1, 21), (2, None), (3, 30), (4, None), (5, None), (6, None)]


def test_asof_on_empty_tables(spark):
    some, none = rows(spark, [(1, "2024-01-03 10:00:00", 1)]), rows(spark, [])
    assert [r.right_v for r in asof_join(some, none, "t", "k", DAY).collect()] == [None]
    assert asof_join(none, some, "t", "k", DAY).count() == 0


@pytest.mark.parametrize("kind", tables.FORMATS)
def test_tables_come_back_as_written(spark, tmp_path, kind):
    frame = spark.createDataFrame([(1, "a,b\n\"c\"", 0.5), (2, None, None), (3, "é", -1.0)], "i long, s string, x double")
    tables.write(frame, str(tmp_path / kind), kind)
    assert sorted(tables.read(spark, str(tmp_path / kind), kind, frame.schema).collect()) == sorted(frame.collect())


def test_partition_folders_are_pruned(spark, tmp_path):
    tables.write(spark.range(10).withColumn("part", F.col("id") % 3), str(tmp_path / "t"), partition_by=("part",))
    found = tables.read(spark, str(tmp_path / "t")).where("part = 1")
    assert found.count() == 3
    assert "PartitionFilters: [isnotnull(part" in found._jdf.queryExecution().toString()


def test_formats_that_are_refused(spark):
    with pytest.raises(ValueError):
        tables.read(spark, "x", "csv")
    with pytest.raises(ValueError):
        tables.read(spark, "x", "exe")


def test_functions_with_nulls(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), ("a", 31.0)], "k string, v double")
    assert sorted(frame.select(udfs.bucket_of("v").alias("b")).collect(), key=repr) == sorted([(0,), (None,), (None,), (3,)], key=repr)
    assert {tuple(r) for r in udfs.value_range(frame, "k", "v").collect()} == {("a", 30.0, 3), ("b", None, 1)}
    assert udfs.value_range(frame.limit(0), "k", "v").count() == 0
    pair = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r.c if r.c is None else round(r.c, 6) for r in pair.select(udfs.cosine("a", "b").alias("c")).collect()] == [0.707107, None]


def test_stream_keeps_every_event_once(spark, sf_dir):
    found = event_stream.first_events(spark, sf_dir)
    assert found.count() == found.distinct().count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def three_files(spark, folder, sf_dir):
    """The events in three files, of which the last also brings one row that is a week late."""
    import time

    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").toPandas()
    late = events.iloc[:1].copy()
    late["event_id"] = events["event_id"].max() + 1
    (folder / "events.parquet").mkdir()
    import pandas as pd

    third = len(events) // 3
    for k, part in enumerate([events.iloc[:third], events.iloc[third : 2 * third], pd.concat([events.iloc[2 * third :], late])]):
        part.to_parquet(folder / "events.parquet" / f"{k}.parquet", coerce_timestamps="us", index=False)
        time.sleep(1.1)  # files are taken by the time they were changed
    return str(folder), events, late


def test_streams_over_several_batches(spark, sf_dir, tmp_path):
    folder, events, late = three_files(spark, tmp_path, sf_dir)
    every = spark.read.parquet(f"{folder}/events.parquet")
    got = {r.user_id: (r.n, r.last_id) for r in event_stream.user_state(spark, folder, 1).collect()}
    assert got == {r.user_id: (r.n, r.last_id) for r in every.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id")).collect()}
    with pytest.raises(ValueError):
        event_stream.run_available(event_stream.event_stream(spark, folder), "update")

    late_id = int(late["event_id"].iloc[0])
    on_time = [(r.ts.to_pydatetime(), int(r.event_id)) for r in events.itertuples() if r.event_id != late_id]
    end = max(t for t, _ in on_time) - timedelta(hours=1)
    want = Counter(t.replace(minute=0, second=0, microsecond=0) for t, _ in on_time)
    hours = {r.hour: r.n for r in event_stream.closed_hours(spark, folder, 1).collect()}
    assert hours == {h: n for h, n in want.items() if h + timedelta(hours=1) <= end}  # the late row is in none of them


def test_sessions_over_several_batches(spark, sf_dir, tmp_path):
    """The sessions of a table, but for the row that came a week late: its session is told as it is without it."""
    folder, events, _ = three_files(spark, tmp_path, sf_dir)
    want = {}
    for user, own in events.groupby("user_id"):
        for t, i in sorted(zip(own["ts"].dt.to_pydatetime(), own["event_id"], strict=True)):
            last = want.get(user, [[]])[-1]
            if last and t - last[-1][0] < timedelta(hours=1):
                last.append((t, i))
            else:
                want.setdefault(user, []).append([(t, i)])
    got = sorted((r.user_id, r.start, r.n, r.first_event) for r in event_stream.user_sessions(spark, folder, 1).collect())
    assert got == sorted((user, v[0][0], len(v), min(i for _, i in v)) for user, visits in want.items() for v in visits)


def test_users_whose_events_have_no_id(spark, tmp_path):
    rows = spark.createDataFrame([(None, "2024-01-01 00:00:00", 7), (None, "2024-01-01 01:00:00", 7), (3, "2024-01-01 02:00:00", 8), (None, "2024-01-01 03:00:00", 8)], "event_id long, ts string, user_id long")
    rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    assert {tuple(r) for r in event_stream.user_state(spark, str(tmp_path)).collect()} == {(7, 2, None), (8, 2, 3)}
