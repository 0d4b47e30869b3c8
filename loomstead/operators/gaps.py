"""Gap filling: a calendar for each key, and values carried or interpolated over the steps that have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a column gets where its key has no row: nothing, zero, the value before or after, or a point of the line between both.
FILLS = ("null", "zero", "before", "after", "line")


def fill_gaps(df: DataFrame, by: tuple[str, ...], at: str, seconds: int, fills: dict[str, str]) -> DataFrame:
    """A row for every step of every key from its first to its last, with the columns of ``fills``.

    ``at`` is a time (with or without zone) on the steps, ``seconds`` apart and counted from 1970; ``df`` has a row a key
    and step at most, so aggregate before: then a key has no more rows than the calendar has steps, however many events it
    had, and windows by key are as small. ``fills`` maps each value column to one of ``FILLS``. ``line`` needs numbers and gives
    doubles; before the first value and after the last one there is no line, and a column stays null there.
    A null value in ``df`` is filled like a missing row. ``filled`` tells rows that ``df`` doesn't
    have. Rows with a null time are left out, a null key is a key. An empty table stays so.
    """
    if seconds < 1 or not set(fills.values()) <= set(FILLS):
        raise ValueError(f"steps have a second or more, and fills are of {', '.join(FILLS)}")
    kind = df.schema[at].dataType.simpleString()
    keys, values = [f"k{i}" for i in range(len(by))], [f"v{i}" for i in range(len(fills))]
    moment = F.col(f"`{at}`")
    if kind == "timestamp_ntz":
        whole = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), moment)
    else:
        whole = F.unix_seconds(moment)
    step = F.call_function("div", whole - F.pmod(whole, F.lit(seconds)), F.lit(seconds))
    rows = df.where(moment.isNotNull()).select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], step.alias("step"), *[F.col(f"`{c}`").alias(v) for c, v in zip(fills, values, strict=True)], F.lit(True).alias("own"))

    # The calendar of each key, then the key's own rows: of each step one row stays, with its values if there are any.
    spine = rows.groupBy(*keys).agg(F.min("step").alias("a"), F.max("step").alias("b")).where("a is not null").select(*keys, F.explode(F.sequence("a", "b")).alias("step"))
    steps = rows.unionByName(spine, allowMissingColumns=True).groupBy(*keys, "step").agg(*[F.max(v).alias(v) for v in values], F.max("own").alias("own"))

    near = Window.partitionBy(*keys).orderBy("step") if keys else Window.partitionBy(F.lit(0)).orderBy("step")
    before, after = near.rowsBetween(Window.unboundedPreceding, 0), near.rowsBetween(0, Window.unboundedFollowing)

    def filled(v: str, how: str):
        value = F.col(v)
        if how == "null":
            return value
        if how == "zero":
            return F.coalesce(value, F.lit(0).cast(steps.schema[v].dataType))
        last, following = F.last(v, ignorenulls=True).over(before), F.first(v, ignorenulls=True).over(after)
        if how in ("before", "after"):
            return last if how == "before" else following
        point = F.when(value.isNotNull(), F.col("step"))
        a, b = F.last(point, ignorenulls=True).over(before), F.first(point, ignorenulls=True).over(after)
        low, high = last.cast("double"), following.cast("double")
        return F.when(a == b, low).otherwise(low + (high - low) * (F.col("step") - a) / (b - a))

    if kind == "timestamp_ntz":
        time = F.timestamp_add("SECOND", F.col("step") * seconds, F.lit("1970-01-01").cast("timestamp_ntz"))
    else:
        time = F.timestamp_seconds(F.col("step") * seconds)
    return steps.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], time.alias(at), *[filled(v, how).alias(c) for (c, how), v in zip(fills.items(), values, strict=True)], F.col("own").isNull().alias("filled"))
