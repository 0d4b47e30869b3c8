"""Places and running sums over a global order, as prefix scans over range partitions.

A window without a partition key puts all rows in one task. Here rows are dealt by range and
sorted where they are; each range's count or sum (one row a range) is added up on the driver,
and every row then adds its range's start to its own place or sum.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.storage import durable

#: ``monotonically_increasing_id`` is the partition's number, shifted by so many bits, and the row's place in it.
_BITS = 33


def _free(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _starts(ordered: DataFrame, part: Column, amount: Column, kind: str) -> Column:
    """What the ranges before ``part`` add up to; one row a range goes to the driver."""
    found = {r[0]: r[1] for r in ordered.groupBy(part.alias("part")).agg(amount.alias("amount")).collect()}
    sizes = [found.get(i) or 0 for i in range(max(found, default=0) + 1)]
    starts = ",".join(map(str, [0, *accumulate(sizes)][: len(sizes)]))
    return F.element_at(F.split(F.lit(starts), ",").cast(f"array<{kind}>"), (part + 1).cast("int"))


def _ordered(df: DataFrame, order: list[Column], at: str, parts: int | None) -> DataFrame:
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return durable(placed.withColumn(at, F.monotonically_increasing_id()), "ordered")


def number_rows(df: DataFrame, order: list[Column], name: str = "place", parts: int | None = None) -> DataFrame:
    """Add each row's place, from 0 without gaps, in the order of all rows.

    One range shuffle; the sorted rows are written once to shared storage, so that places
    hold if tasks run again. Rows that tie in all of ``order`` get neighbouring places in any
    order and stay in one range: give a last expression that tells rows apart where many may
    tie. Nulls stand where the expressions of ``order`` put them. An empty table stays so.
    A column called ``name`` is replaced.
    """
    at = _free(df, "__at")
    ordered = _ordered(df.drop(name), order, at, parts)
    part = F.shiftright(at, _BITS)
    start = _starts(ordered, part, F.count("*"), "bigint")
    return ordered.withColumn(name, start + F.col(at).bitwiseAND((1 << _BITS) - 1)).drop(at)


def running_sum(df: DataFrame, order: list[Column], value: str, name: str = "running", parts: int | None = None) -> DataFrame:
    """Add the sum of ``value`` over all rows up to and with each one, in the order of all rows.

    Integers and decimals add up exactly. Nulls add nothing, and the sum is 0 before the first
    value; the other cases are those of :func:`number_rows`. A range's rows meet in one window,
    which spills.
    """
    at, part = _free(df, "__at"), _free(df, "__part")
    ordered = _ordered(df.drop(name) if name != value else df, order, at, parts).withColumn(part, F.shiftright(at, _BITS))
    summed = F.sum(value)
    kind = ordered.agg(summed.alias("s")).schema[0].dataType.simpleString()
    start = _starts(ordered, F.col(part), summed, kind)
    own = F.coalesce(summed.over(Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0).cast(kind))
    return ordered.withColumn(name, start + own).drop(at, part)
