"""Queries that profile: exact quantiles, stored sketches, variants, filled gaps, paths, and a table with zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.functions import paths, sketches, variants
from loomstead.operators.gaps import fill_gaps
from loomstead.operators.quantiles import exact_quantiles
from loomstead.session import table
from loomstead.sources import zoned
from loomstead.storage import durable, new_path


def brand_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quartiles of each brand's prices."""
    found = exact_quantiles(table(spark, sf_dir, "part"), ("p_brand",), "p_retailprice", (0.25, 0.5, 0.75))
    return found.select("p_brand", "fraction", "n", F.round("quantile", 6).alias("price"))


def line_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of the prices of lines in a few large groups: least values that a share doesn't exceed."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    found = exact_quantiles(lines, ("l_returnflag", "l_linestatus"), "l_extendedprice", (0.01, 0.5, 0.99), "disc")
    return found.select("l_returnflag", "l_linestatus", "fraction", F.col("quantile").alias("price"))


def daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and median value by day, from sketches stored by hour and event type, held against the exact ones.

    ``users_near`` tells whether the estimate is within three standard errors, ``median_near``
    whether the exact rank of the median is within KLL's bound.
    """
    events = table(spark, sf_dir, "events").select("ts", "event_type", "user_id", "value")
    hours = durable(sketches.sketch(events, {"hour": F.date_trunc("hour", "ts"), "event_type": F.col("event_type")}, "user_id", "value"), "sketches")
    days = sketches.merge(hours, {"day": F.col("hour").cast("date")}).select("day", "n", sketches.distinct().alias("about"), sketches.quantile(0.5).alias("middle"))
    exact = events.join(F.broadcast(days), F.col("ts").cast("date") == F.col("day"))  # a row a day
    counted = exact.groupBy("day", "n", "about").agg(F.count_distinct("user_id").alias("users"), (F.count_if(F.col("value") <= F.col("middle")) / F.count("value")).alias("through"), (F.count_if(F.col("value") < F.col("middle")) / F.count("value")).alias("below"))
    near = F.abs(F.col("about") - F.col("users")) <= 3 * sketches.DISTINCT_ERROR * F.col("users") + 0.5
    return counted.select("day", "n", "users", near.alias("users_near"), ((F.col("through") >= 0.5 - sketches.RANK_ERROR) & (F.col("below") <= 0.5 + sketches.RANK_ERROR)).alias("median_near"))


def props_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of each event's JSON by event type, from a variant column, with the schema that all rows have."""
    events = table(spark, sf_dir, "events").select("event_type", "props")
    read = variants.fields(events, "props", {"k": ("$.k", "long"), "none": ("$.k.inner[0]", "string")})
    found = read.groupBy("event_type").agg(F.sum("k").alias("total"), F.count_if("malformed").alias("malformed"), F.count("none").alias("nested"), F.schema_of_variant_agg("variant").alias("schema"))
    return found


def hourly_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event type's hours: users (0 in a gap), the last event before (carried), and the largest value (on a line)."""
    events = table(spark, sf_dir, "events")
    hours = events.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count_distinct("user_id").alias("users"), F.max("event_id").alias("last_id"), F.max("value").alias("peak"))
    found = fill_gaps(hours, ("event_type",), "hour", 3600, {"users": "zero", "last_id": "before", "peak": "line"})
    return found.select("event_type", "hour", "users", "last_id", "peak", "filled")


def view_click_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' neighbouring events view, click, then anything: a table function whose columns the pattern decides."""
    paths.register(spark)
    return spark.sql("SELECT * FROM path_matches(TABLE({events}), 'view>click>*', 'user_id', 'ts', 'event_id', 'event_type')", events=table(spark, sf_dir, "events"))


def zoned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a week, read from a table with zones into which all events were written by time."""
    zoned.register(spark)
    path = new_path(spark, "zoned")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    events.repartitionByRange(8, "ts").sortWithinPartitions("ts").write.format("zoned").mode("append").option("filerows", 100_000).save(path)
    week = spark.read.format("zoned").load(path).where("ts >= timestamp_ntz'2024-01-08' and ts < timestamp_ntz'2024-01-15'")
    return week.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.max("event_id").alias("last_id"))


QUERIES = {f.__name__: f for f in (brand_medians, line_percentiles, daily_sketches, props_variants, hourly_users, view_click_paths, zoned_events)}

SQL = {
    "brand_medians": """
        SELECT p_brand, fraction, n, round(price, 6) AS price FROM (
            SELECT p_brand, count(p_retailprice) AS n, unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS fraction, unnest(quantile_cont(p_retailprice, [0.25, 0.5, 0.75])) AS price
            FROM part GROUP BY p_brand)
    """,
    "line_percentiles": """
        SELECT l_returnflag, l_linestatus, unnest([0.01::DOUBLE, 0.5::DOUBLE, 0.99::DOUBLE]) AS fraction, unnest(quantile_disc(l_extendedprice, [0.01, 0.5, 0.99])) AS price
        FROM lineitem GROUP BY l_returnflag, l_linestatus
    """,
    "daily_sketches": "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_near, true AS median_near FROM events GROUP BY 1",
    "props_variants": """
        SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) FILTER (NOT json_valid(props)) AS malformed,
            count(json_extract_string(props, '$.k.inner[0]')) AS nested, 'OBJECT<' || any_value(json_keys(props)[1]) || ': ' || any_value(replace(json_type(props, '$.k'), 'UBIGINT', 'BIGINT')) || '>' AS schema
        FROM events GROUP BY event_type
    """,
    "hourly_users": """
        WITH own AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(DISTINCT user_id) AS users, max(event_id) AS last_id, max(value) AS peak FROM events GROUP BY 1, 2),
        spine AS (SELECT event_type, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM own GROUP BY 1),
        both_ AS (SELECT s.event_type, s.hour, users, last_id, peak, CASE WHEN users IS NOT NULL THEN s.hour END AS point FROM spine s LEFT JOIN own USING (event_type, hour)),
        near AS (
            SELECT *, last_value(last_id IGNORE NULLS) OVER b AS carried, last_value(peak IGNORE NULLS) OVER b AS low, first_value(peak IGNORE NULLS) OVER a AS high,
                epoch(last_value(point IGNORE NULLS) OVER b) AS x, epoch(first_value(point IGNORE NULLS) OVER a) AS y
            FROM both_ WINDOW b AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT event_type, hour, coalesce(users, 0) AS users, carried AS last_id, CASE WHEN x = y THEN low ELSE low + (high - low) * ((epoch(hour) - x) / 3600) / ((y - x) / 3600) END AS peak, users IS NULL AS filled FROM near
    """,
    "view_click_paths": """
        SELECT user_id, a AS view_1, b AS click_2, c AS any_3 FROM (
            SELECT user_id, event_type, event_id AS c, lag(event_id) OVER w AS b, lag(event_id, 2) OVER w AS a, lag(event_type) OVER w AS kb, lag(event_type, 2) OVER w AS ka
            FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        WHERE ka = 'view' AND kb = 'click'
    """,
    "zoned_events": """
        SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, max(event_id) AS last_id FROM events
        WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' GROUP BY event_type
    """,
}
