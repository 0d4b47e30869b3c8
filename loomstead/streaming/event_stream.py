"""Structured Streaming over event files: watermarked windows, sessions, deduplication and keyed state.

Each query reads a folder or file of events as a stream, runs all that is available and
returns the sink's table. Sinks and stream checkpoints lie in shared storage, so a driver or
executor that is lost resumes from the last committed batch.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomstead.session import table


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("loomstead.stream.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomstead-stream-")
        spark.conf.set("loomstead.stream.dir", base)
    return f"{base.rstrip('/')}/streams/{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str, files_a_batch: int = 1000) -> DataFrame:
    """The events as a stream, at most ``files_a_batch`` files at a time; ``ts`` becomes a timestamp, which watermarks need."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Run a stream over all that is there and return what the sink holds at the end.

    ``append`` writes each final row once to Parquet. ``complete`` replaces the table with
    each batch's result, which is the whole one. ``update`` writes each batch's rows to a
    folder of its own, so that a batch that runs again replaces itself, and returns the
    latest row of each of the ``keys``.
    """
    spark = stream.sparkSession
    folder = _folder(spark)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").outputMode(mode)
    if mode == "update" and not keys:
        raise ValueError("rows of update mode are told apart by keys")
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/rows").start()
    elif mode == "complete":
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/rows")).start()
    else:
        query = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")).start()
    query.awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(f"{folder}/rows")
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("latest"))
    return latest.select("latest.*")


def daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling days by event type behind a watermark, as a complete table."""
    events = event_stream(spark, sf_dir).withWatermark("ts", "1 hour")
    found = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))
    return run_available(found.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "last_id"), "complete")


def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplication within a watermark: each event id once, however often it arrives."""
    events = event_stream(spark, sf_dir).withWatermark("ts", "1 hour")
    twice = events.unionByName(events).dropDuplicatesWithinWatermark(["event_id"])
    return run_available(twice.select("event_id", "user_id"))


def count_users(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Running count and largest event id of a user, kept over batches in two longs; without any id the latter is null."""
    n, last = state.get if state.exists else (0, None)
    for batch in batches:
        ids = batch["event_id"].dropna()
        n += len(batch)
        if len(ids):
            last = max(int(ids.max()), int(ids.max()) if last is None else last)
    state.update((n, last))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_id": pd.array([last], dtype="Int64")})


def user_state(spark: SparkSession, sf_dir: str, files_a_batch: int = 1000) -> DataFrame:
    """Custom keyed state: every user's count and last event, as of the last batch that had the user."""
    events = event_stream(spark, sf_dir, files_a_batch).where("user_id is not null").select("user_id", "event_id")
    found = events.groupBy("user_id").applyInPandasWithState(count_users, "user_id long, n long, last_id long", "n long, last_id long", "update", GroupStateTimeout.NoTimeout)
    return run_available(found, "update", ("user_id",))


def user_sessions(spark: SparkSession, sf_dir: str, files_a_batch: int = 1000) -> DataFrame:
    """Each user's sessions, events less than an hour apart, merged over batches as a complete table."""
    events = event_stream(spark, sf_dir, files_a_batch).withWatermark("ts", "1 hour")
    found = events.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))
    return run_available(found.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "first_event"), "complete")


def closed_hours(spark: SparkSession, sf_dir: str, files_a_batch: int = 1000) -> DataFrame:
    """Events of each hour that the watermark has passed; rows that come later than it are dropped."""
    events = event_stream(spark, sf_dir, files_a_batch).withWatermark("ts", "1 hour")
    found = events.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return run_available(found.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"stream_{f.__name__}": f for f in (daily_totals, first_events, user_state, user_sessions, closed_hours)}

SQL = {
    "stream_daily_totals": "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1, 2",
    "stream_first_events": "SELECT event_id, user_id FROM events",
    "stream_user_sessions": """
        SELECT user_id, min(ts) AS start, count(*) AS n, min(event_id) AS first_event FROM (
            SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
                SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events))
        GROUP BY user_id, s
    """,
    "stream_closed_hours": """
        SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1
        HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
    """,
    "stream_user_state": "SELECT user_id, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY user_id",
}
