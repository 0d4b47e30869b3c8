"""Queries over the event log: analytic windows, time windows, sessions, as-of joins, JSON and Python functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstead.functions import udfs
from loomstead.operators.asof import asof_join
from loomstead.session import table


def event_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking and analytic functions over each user's events."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    by_value = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return events.select(
        "event_id",
        F.row_number().over(by_time).cast("long").alias("nth"),
        F.rank().over(by_value).cast("long").alias("value_rank"),
        F.ntile(4).over(by_time).cast("long").alias("quarter"),
        F.lag("event_id").over(by_time).alias("previous"),
        F.lead("event_id", 2).over(by_time).alias("next_but_one"),
        F.first("event_id").over(by_time).alias("first_event"),
        F.count("*").over(by_time.rowsBetween(-3, 0)).alias("last_four"),
    )


def daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the same user in the day up to each event (a range frame over time)."""
    events = table(spark, sf_dir, "events")
    frame = "PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW"
    return events.select("event_id", F.expr(f"count(*) OVER ({frame})").alias("in_a_day"), F.expr(f"max(event_id) OVER ({frame})").alias("last_id"))


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of an hour."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def sliding_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users of every day that starts at midnight or noon."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.window("ts", "1 day", "12 hours").alias("w")).agg(F.count_distinct("user_id").alias("users")).select(F.col("w.start").alias("start"), "users")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's sessions: events less than an hour apart."""
    events = table(spark, sf_dir, "events")
    found = events.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))
    return found.select("user_id", F.col("w.start").alias("start"), "n", "first_event")


def last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's latest view at each purchase (as-of join)."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    purchases = events.where("event_type = 'purchase'").drop("event_type")
    views = events.where("event_type = 'view'").drop("event_type")
    return asof_join(purchases, views, "ts", "user_id", "date_trunc('day', __on)", "view_").select("event_id", "user_id", "ts", "view_event_id", "view_ts")


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON field by path and by schema."""
    events = table(spark, sf_dir, "events")
    by_schema = F.from_json("props", "k int")["k"]
    return events.groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"), F.max(by_schema).alias("by_schema"))


def type_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps and arrays: each user's counts by event type, and the types met."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    found = counts.groupBy("user_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    return found.select("user_id", F.array_join(F.map_keys("m"), ",").alias("types"), F.coalesce(F.col("m")["click"], F.lit(0)).alias("clicks"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def value_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar function over Arrow batches."""
    events = table(spark, sf_dir, "events")
    return events.select(udfs.bucket_of("value").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def value_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mergeable user-defined aggregate: partial states by task, one row a state in the shuffle."""
    return udfs.value_range(table(spark, sf_dir, "events"), "event_type", "value").select("event_type", F.round("spread", 6).alias("spread"), "n")


def props_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function: a row for each field of each event's JSON."""
    spark.udtf.register("json_fields", udfs.JsonFields)
    found = spark.sql("SELECT f.field, f.number FROM {events} e, LATERAL json_fields(e.props) f", events=table(spark, sf_dir, "events"))
    return found.groupBy("field").agg(F.count("*").alias("n"), F.sum("number").alias("total"))


def next_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector with that of the next id, in double precision and without Python."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u"))
    return rows.join(after, "vec_id").select("vec_id", F.round(udfs.cosine("v", "u"), 5).alias("cosine"))


QUERIES = {f.__name__: f for f in (event_ranks, daily_activity, hourly_counts, sliding_users, sessions, last_view, event_props, type_profiles, value_buckets, value_ranges, props_fields, next_vector)}

SQL = {
    "event_ranks": """
        SELECT event_id, row_number() OVER t AS nth, rank() OVER v AS value_rank, ntile(4) OVER t AS quarter, lag(event_id) OVER t AS previous,
            lead(event_id, 2) OVER t AS next_but_one, first_value(event_id) OVER t AS first_event,
            count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS last_four
        FROM events WINDOW t AS (PARTITION BY user_id ORDER BY ts, event_id), v AS (PARTITION BY user_id ORDER BY value DESC, event_id)
    """,
    "daily_activity": """
        SELECT event_id, count(*) OVER w AS in_a_day, max(event_id) OVER w AS last_id
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)
    """,
    "hourly_counts": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
    "sliding_users": """
        SELECT start, count(DISTINCT user_id) AS users FROM (
            SELECT user_id, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS start FROM events)
        GROUP BY start
    """,
    "sessions": """
        SELECT user_id, min(ts) AS start, count(*) AS n, min(event_id) AS first_event FROM (
            SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
                SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events))
        GROUP BY user_id, s
    """,
    "last_view": """
        SELECT p.event_id, p.user_id, p.ts, v.event_id AS view_event_id, v.ts AS view_ts
        FROM (SELECT * FROM events WHERE event_type = 'purchase') p
        ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts
    """,
    "event_props": """
        SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n, CAST(json_extract_string(props, '$.k') AS INTEGER) AS by_schema
        FROM events GROUP BY 1, 3
    """,
    "type_profiles": """
        SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types,
            count(*) FILTER (event_type = 'click') AS clicks, count(*) AS total
        FROM events GROUP BY user_id
    """,
    "value_buckets": "SELECT CAST(floor(value / 10) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1",
    "value_ranges": "SELECT event_type, round(max(value) - min(value), 6) AS spread, count(*) AS n FROM events GROUP BY event_type",
    "props_fields": "SELECT 'k' AS field, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events",
    "next_vector": """
        SELECT e.vec_id, round(list_dot_product(e.v, f.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(f.v, f.v))), 5) AS cosine
        FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) f ON f.vec_id = e.vec_id + 1
    """,
}
