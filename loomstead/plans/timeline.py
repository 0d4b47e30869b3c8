"""Queries along time: running sums over all days, overlapping intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.operators.intervals import interval_join
from loomstead.operators.overlaps import overlap_counts
from loomstead.operators.running import running_sum
from loomstead.session import table


def cumulative_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounted revenue of each day of shipping, and of all days up to it."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day"))
    units = F.round(F.col("l_extendedprice") * 100).cast("long") * F.round((1 - F.col("l_discount")) * 100).cast("long")  # whole, so that sums are exact
    summed = running_sum(lines.agg(F.sum(units).alias("revenue")), [F.col("day")], "revenue", "total")
    return summed.select("day", (F.col("revenue") / 10000).alias("revenue"), (F.col("total") / 10000).alias("total"))


def overlapping_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With how many sessions of others each user's sessions overlap."""
    events = table(spark, sf_dir, "events")
    found = events.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    sessions = found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"))
    return overlap_counts(sessions, "user_id", ("start", "end"))


def overlapping_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a customer's orders of which the first is still being shipped on the other's first day, or the other way round."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").cast("date").alias("first"), F.date_add(F.max("l_shipdate").cast("date"), 1).alias("after"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    shipped = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", "first", "after")
    pairs = interval_join(shipped, shipped, ("first", "after"), ("first", "after"), 256, ("o_custkey",)).where("o_orderkey < right_o_orderkey")
    days = F.date_diff(F.least("after", "right_after"), F.greatest("first", "right_first"))
    return pairs.groupBy("o_custkey").agg(F.count("*").alias("pairs"), F.sum(days).alias("days"))


QUERIES = {f.__name__: f for f in (cumulative_revenue, overlapping_sessions, overlapping_shipments)}

SQL = {
    "cumulative_revenue": """
        SELECT day, revenue / 10000 AS revenue, CAST(sum(revenue) OVER (ORDER BY day) AS BIGINT) / 10000 AS total FROM (
            SELECT CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round((1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS revenue
            FROM lineitem GROUP BY 1)
    """,
    "overlapping_sessions": """
        WITH marked AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events),
        numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM marked),
        found AS (SELECT user_id, min(ts) AS b, max(ts) + INTERVAL 1 HOUR AS e FROM numbered GROUP BY user_id, s)
        SELECT x.user_id, count(*) AS overlaps, count(DISTINCT y.user_id) AS others FROM found x JOIN found y ON x.b < y.e AND y.b < x.e AND x.user_id <> y.user_id GROUP BY x.user_id
    """,
    "overlapping_shipments": """
        WITH shipped AS (
            SELECT o_custkey, o_orderkey, CAST(min(l_shipdate) AS DATE) AS b, CAST(max(l_shipdate) AS DATE) + 1 AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
        SELECT x.o_custkey, count(*) AS pairs, CAST(sum(date_diff('day', greatest(x.b, y.b), least(x.e, y.e))) AS BIGINT) AS days
        FROM shipped x JOIN shipped y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND x.b < y.e AND y.b < x.e GROUP BY 1
    """,
}
