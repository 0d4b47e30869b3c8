"""The zoned format: round trips, commits that are all or nothing, and files that a filter skips."""

import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstead.sources import zoned


@pytest.fixture(scope="module")
def zoned_spark(spark):
    zoned.register(spark)
    return spark


def made(spark, n=1000):
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600)
    return spark.range(n).select("id", (F.col("id") * 0.5).alias("x"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("k"), F.lpad("id", 5, "0"))).alias("s"), at.cast("timestamp_ntz").alias("t"), at.cast("date").alias("d"), F.array("id").alias("a"))


def put(frame, path, **options):
    frame.repartitionByRange(5, "id").sortWithinPartitions("id").write.format("zoned").mode(options.pop("mode", "append")).options(**options).save(path)


def test_rows_come_back(zoned_spark, tmp_path):
    path, frame = str(tmp_path / "t"), made(zoned_spark)
    put(frame, path, filerows=70)
    put(frame.limit(0), path)
    back = zoned_spark.read.format("zoned").load(path)
    assert back.schema == frame.schema and sorted(back.collect()) == sorted(frame.collect())
    put(frame.where("id < 10"), path)
    assert zoned_spark.read.format("zoned").load("file://" + path).count() == 1010
    put(frame.where("id < 10"), path, mode="overwrite")
    assert sorted(r.id for r in zoned_spark.read.format("zoned").load(path).collect()) == list(range(10))


@pytest.mark.parametrize(
    ("test", "parts"),
    [
        ("id = 500", 1), ("id < 100", 3), ("id >= 990 and id <= 2000", 1), ("s = 'k00999'", 1), ("id in (3, 555)", 2), ("x > 499", 1), ("id > 5000", 1),
        ("t < timestamp_ntz'2023-11-15 00:00:00'", 1), ("d = date'2023-11-20'", 2), ("id <=> 17", 1), ("id + 1 = 20", 25), ("id = 500 or id = 1", 25),
    ],
)
def test_filters_skip_files(zoned_spark, tmp_path, test, parts):
    path, frame = str(tmp_path / "t"), made(zoned_spark)
    put(frame, path, filerows=50)
    found = zoned_spark.read.format("zoned").option("splitrows", 1).load(path).where(test)
    assert sorted(found.collect()) == sorted(frame.where(test).collect())
    assert found.rdd.getNumPartitions() <= parts


def test_what_is_not_committed_does_not_exist(zoned_spark, tmp_path):
    path = str(tmp_path / "t")
    put(made(zoned_spark, 100), path)
    writer = zoned._Writer(path, made(zoned_spark, 1).schema, False, 10)
    batch = pa.record_batch({"id": pa.array(range(25))})
    message = writer.write(iter([batch]))
    assert [f["rows"] for f in message.files] == [10, 10, 5] and message.files[1]["zones"]["id"] == [10, 19, 0]
    assert zoned_spark.read.format("zoned").load(path).count() == 100
    held = set(os.listdir(f"{path}/data"))
    writer.abort([message, None])
    assert len(held) - len(os.listdir(f"{path}/data")) == 3
    for name in os.listdir(f"{path}/commits"):
        assert json.load(open(f"{path}/commits/{name}"))["number"] == 1

    @F.udf("long")
    def fails(i):
        if i == 99:
            raise ValueError("late failure")
        return i

    with pytest.raises(Exception, match="late failure"):
        made(zoned_spark, 100).select(fails("id").alias("id"), "x", "s", "t", "d", "a").write.format("zoned").mode("append").save(path)
    assert zoned_spark.read.format("zoned").load(path).count() == 100


def test_no_table(zoned_spark, tmp_path):
    with pytest.raises(Exception, match="no table at"):
        zoned_spark.read.format("zoned").load(str(tmp_path / "none")).count()


def test_files_that_no_commit_names_are_cleared(zoned_spark, tmp_path):
    path, frame = str(tmp_path / "t"), made(zoned_spark, 100)
    put(frame, path)
    put(frame.where("id < 50"), path, mode="overwrite")
    zoned._Writer(path, frame.schema, False, 10).write(iter([pa.record_batch({"id": pa.array(range(25))})]))
    held = len(os.listdir(f"{path}/data"))
    assert zoned.clear(path) >= 4 and zoned.clear(path) == 0
    assert 0 < len(os.listdir(f"{path}/data")) < held
    assert zoned_spark.read.format("zoned").load(path).count() == 50
    assert zoned.clear(str(tmp_path / "none")) == 0


def test_streams_read_and_write_each_commit_once(zoned_spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("source", "sink", "state"))
    frame = made(zoned_spark, 90)

    def run():
        stream = zoned_spark.readStream.format("zoned").option("splitrows", 10).load(source).select("id", "s")
        query = stream.writeStream.format("zoned").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r.id for r in zoned_spark.read.format("zoned").load(sink).collect())

    put(frame.where("id < 30"), source)
    put(frame.where("id >= 30 and id < 60"), source)
    assert run() == list(range(60))
    put(frame.where("id >= 60"), source)
    assert run() == list(range(90)) == run()
    writer = zoned._StreamWriter(sink, frame.select("id", "s").schema, 100, "stream")
    again = writer.write(iter([pa.record_batch({"id": pa.array([1]), "s": pa.array(["x"])})]))
    writer.commit([again], 0)  # a batch that was published already
    assert zoned_spark.read.format("zoned").load(sink).count() == 90
    put(frame, source, mode="overwrite")
    with pytest.raises(Exception, match="replaced under the stream"):
        run()
