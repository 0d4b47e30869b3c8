"""Streams that join each other, and keyed state with event-time timers.

Both keep state only as long as the watermark asks: the join's time bound and the timers let it go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomstead.streaming.event_stream import event_stream, run_available

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _viewed_before(spark: SparkSession, sf_dir: str, files_a_batch: int, late: str, within: str, how: str) -> DataFrame:
    """Purchases with the same user's views of the time ``within`` before each; both sides may be ``late``."""
    of = lambda kind: event_stream(spark, sf_dir, files_a_batch).where(F.col("event_type") == kind)
    purchases = of("purchase").select("user_id", "event_id", "ts").withWatermark("ts", late)
    views = of("view").select(F.col("user_id").alias("viewer"), F.col("event_id").alias("view_id"), F.col("ts").alias("view_ts")).withWatermark("view_ts", late)
    near = F.expr(f"user_id = viewer AND view_ts <= ts AND view_ts >= ts - INTERVAL {within}")
    return purchases.join(views, near, how)


def viewed_purchases(spark: SparkSession, sf_dir: str, files_a_batch: int = 1000, late: str = "1 hour") -> DataFrame:
    """Stream-stream join: each purchase with the user's views of the day before it.

    A view leaves the state once the watermark is a day past it, a purchase once no view before it
    can come any more. Rows that come later than the watermark are dropped on either side.
    """
    found = _viewed_before(spark, sf_dir, files_a_batch, late, "1 DAY", "inner")
    return run_available(found.select("user_id", "event_id", "view_id"))


def unviewed_purchases(spark: SparkSession, sf_dir: str, files_a_batch: int = 1000, late: str = "1 hour") -> DataFrame:
    """Outer stream-stream join: purchases without a view in the hour before, told when the watermark is past them."""
    found = _viewed_before(spark, sf_dir, files_a_batch, late, "1 HOUR", "left_outer")
    rows = run_available(found.select("user_id", "event_id", "view_id"))
    return rows.where("view_id is null").select("user_id", "event_id")


class Visits(StatefulProcessor):
    """A user's visits, told by an event-time timer once the user has been idle for ``idle`` seconds.

    State: one value of the open visits in order (starts, last events, numbers of events) and how many visits were closed.
    A user has one timer, for the open visit that is over first. Each access to the state or a timer is a call from
    Python to the JVM, so neither has a row for each visit. Rows may come in any order within the watermark: they
    extend a visit, begin one, or join two.
    """

    def __init__(self, idle: int) -> None:
        self.idle = idle * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("visits", "start array<long>, last array<long>, n array<long>, closed long")

    def _due(self, last: int) -> int:
        """The first millisecond at which a visit of that last event is over."""
        return -(-(last + self.idle) // 1000)

    def _held(self) -> tuple[list[tuple[int, int, int]], int]:
        """Open visits (start, last, n) and the number of closed ones."""
        found = self.state.get()
        return (list(zip(*found[:3], strict=True)), found[3]) if found is not None else ([], 0)

    def _keep(self, visits: list[tuple[int, int, int]], closed: int) -> None:
        columns = zip(*visits, strict=True) if visits else ([], [], [])
        self.state.update((*map(list, columns), closed))

    def _first_due(self, visits: list[tuple[int, int, int]]) -> int | None:
        return min((self._due(last) for _, last, _ in visits), default=None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, closed = self._held()
        spans = list(before)
        for batch in rows:
            spans += [(t, t, 1) for t in batch["at"].astype("int64").tolist()]
        after: list[tuple[int, int, int]] = []
        for start, last, n in sorted(spans):
            if after and start - after[-1][1] < self.idle:
                after[-1] = (after[-1][0], max(last, after[-1][1]), after[-1][2] + n)
            else:
                after.append((start, last, n))
        self._keep(after, closed)
        due, was = self._first_due(after), self._first_due(before)
        if due != was:
            if was is not None:
                self.handle.deleteTimer(was)
            if due is not None:
                self.handle.registerTimer(due)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        moment = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        visits, closed = self._held()
        over = [v for v in visits if self._due(v[1]) <= moment]
        going = [v for v in visits if self._due(v[1]) > moment]
        self._keep(going, closed + len(over))
        if going:
            self.handle.registerTimer(self._first_due(going))
        if over:
            starts, lasts, counts = zip(*over, strict=True)
            yield pd.DataFrame({"user_id": [key[0]] * len(over), "nth": range(closed + 1, closed + 1 + len(over)), "start": starts, "last": lasts, "n": counts})

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """State with timers needs the RocksDB store, which also spills to disk and checkpoints changes only."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def idle_users(spark: SparkSession, sf_dir: str, files_a_batch: int = 1000, late: str = "1 hour") -> DataFrame:
    """Each user's visits, with less than a day between events, that the watermark has left a day behind.

    Events without user or time belong to no visit.
    """
    events = event_stream(spark, sf_dir, files_a_batch).where("user_id is not null and ts is not null").withWatermark("ts", late)
    rows = events.select("user_id", "ts", F.unix_micros("ts").alias("at"))
    with _rocks(spark):
        found = rows.groupBy("user_id").transformWithStateInPandas(Visits(86_400), "user_id long, nth long, start long, last long, n long", "append", "eventTime")
        closed = run_available(found)
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    return closed.select("user_id", "nth", time("start"), time("last"), "n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"stream_{f.__name__}": f for f in (viewed_purchases, unviewed_purchases, idle_users)}

SQL = {
    "stream_viewed_purchases": """
        SELECT p.user_id, p.event_id, v.event_id AS view_id FROM events p JOIN events v
        ON p.user_id = v.user_id AND v.ts <= p.ts AND v.ts >= p.ts - INTERVAL 1 DAY WHERE p.event_type = 'purchase' AND v.event_type = 'view'
    """,
    "stream_unviewed_purchases": """
        SELECT user_id, event_id FROM events p WHERE event_type = 'purchase'
        AND NOT EXISTS (SELECT 1 FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts AND v.ts >= p.ts - INTERVAL 1 HOUR)
        AND ts < (SELECT least(max(ts) FILTER (event_type = 'view'), max(ts) FILTER (event_type = 'purchase')) - INTERVAL 1 HOUR FROM events)
    """,
    "stream_idle_users": """
        SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start) AS nth, start, last, n FROM (
            SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM (
                SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
                    SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events))
            GROUP BY user_id, s)
        WHERE last + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
    """,
}
