"""As-of join: the latest earlier row of another table, without a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, by: str, bucket: str, prefix: str = "right_") -> DataFrame:
    """Join each left row with the right row of the same ``by`` whose ``on`` is the latest not after its own.

    ``bucket`` is a SQL expression that never decreases as the time ``__on`` goes on (such as its day). Rows are windowed
    by ``by`` and bucket, so a hot key is dealt over its buckets; what a bucket carries over
    to the next ones is a row for each key and bucket, joined back. Left rows without a match,
    or with a null key or time, stay with nulls. Of right rows that tie on key and time, the
    one with the largest columns counts.
    """
    names = [c for c in right.columns if c != by]
    held = F.struct(*[F.col(f"r.{c}").alias(c) for c in names])
    events = left.select(F.col(by).alias("__by"), F.col(on).alias("__on"), F.struct(*[F.col(c) for c in left.columns]).alias("__left"), F.lit(None).cast(right.select(F.struct(*names)).schema[0].dataType).alias("__right"))
    known = right.alias("r").where(F.col(by).isNotNull() & F.col(on).isNotNull())
    known = known.select(F.col(by).alias("__by"), F.col(on).alias("__on"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__left"), held.alias("__right"))
    rows = events.unionByName(known).withColumn("__bucket", F.expr(bucket))
    within = Window.partitionBy("__by", "__bucket").orderBy("__on", F.col("__left").isNotNull(), "__right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("__match", F.last("__right", ignorenulls=True).over(within)).where("__left is not null")

    ends = rows.groupBy("__by", "__bucket").agg(F.max(F.when(F.col("__right").isNotNull(), F.struct("__on", "__right"))).alias("__end"))
    before = Window.partitionBy("__by").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("__by", "__bucket", F.last(F.col("__end.__right"), ignorenulls=True).over(before).alias("__carry")).where("__carry is not null")
    out = seen.join(carried, ["__by", "__bucket"], "left").withColumn("__match", F.coalesce("__match", "__carry"))
    matched = [F.when(F.col("__on").isNotNull(), F.col(f"__match.{c}")).alias(f"{prefix}{c}") for c in names]
    return out.select("__left.*", *matched)
