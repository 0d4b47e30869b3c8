"""Join of overlapping intervals by equal keys: time bins of a width that suits each interval, without a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstead.storage import durable

#: Rows of one side that share a bin before the bin is split.
HEAVY = 50_000


def _number(df: DataFrame, column: str) -> Column:
    """A time in microseconds, a date in days, or a whole number."""
    kind, value = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), value)
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long")
    if isinstance(kind, T.IntegralType):
        return value.cast("long")
    raise ValueError(f"{column} is no time, date or whole number")


def _dealt(df: DataFrame, span: tuple[str, str], by: tuple[str, ...], width: int, side: str) -> DataFrame:
    """Rows as one struct, with their keys, ends and level: bins of ``width * 2 ** level`` are so wide that a row meets two at most."""
    start, end = (_number(df, c) for c in span)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(side), *[F.col(f"`{c}`").alias(f"by{i}") for i, c in enumerate(by)], start.alias("start"), end.alias("end"))
    rows = rows.where(" and ".join(["start < end", *[f"by{i} is not null" for i in range(len(by))]]))
    low, high = (F.expr(f"({x} - pmod({x}, {width}L)) div {width}L") for x in ("start", "(end - 1)"))
    return rows.select("*", low.alias("low"), high.alias("high")).withColumn("level", F.when(F.col("low") == F.col("high"), 0).otherwise(F.length(F.bin(F.col("high") - F.col("low")))))


def _levels(dealt: DataFrame) -> list[int]:
    return sorted(r.level for r in dealt.select("level").distinct().collect())  # 64 at most


def _bins(dealt: DataFrame, level: Column) -> DataFrame:
    """A row for each bin of that level that the interval meets."""
    at = dealt.withColumn("at", level)
    shifted = lambda c: F.call_function("shiftright", F.col(c), F.col("at"))
    return at.withColumn("first", shifted("low")).withColumn("bin", F.explode(F.sequence(F.col("first"), shifted("high"))))


def _half(native: DataFrame, wide: DataFrame, side: str, levels: list[int], strict: bool, keys: list[str], heavy: int) -> DataFrame:
    """Pairs at the level of ``native``, which the other side's rows, of levels not above it, are dealt to as well."""
    near = _bins(native, F.col("level"))
    above = F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x > F.col("level") if strict else x >= F.col("level"))
    far = _bins(wide.withColumn("to", F.explode(above)), F.col("to")).drop("to")
    cell = [*keys, "at", "bin"]
    split = far.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > heavy).select(*cell, F.ceil(F.col("n") / heavy).cast("int").alias("splits"))
    # A row of a heavy cell goes to one of its splits by its content; the other side's rows go to each.
    far = far.join(split, cell, "left").withColumn("split", F.coalesce(F.pmod(F.xxhash64(side), F.col("splits")).cast("int"), F.lit(0))).drop("splits")
    near = near.join(split, cell, "left").withColumn("split", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("splits") - 1, F.lit(0))))).drop("splits")
    a, b = near.alias("a"), far.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*cell, "split"]]
    meets = (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    once = F.col("a.bin") == F.greatest("a.first", "b.first")
    pairs = a.join(b, [*same, meets & once])
    return pairs.select("left", "right")


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: int, by: tuple[str, ...] = (), prefix: str = "right_", heavy: int = HEAVY) -> DataFrame:
    """Pairs of rows whose half-open intervals ``[start, end)`` overlap and whose ``by`` columns are equal.

    Ends are times, dates or whole numbers; ``width`` is that of the narrowest bins in microseconds, days or
    units, about the length of a common interval. Longer intervals are dealt to bins twice, four times, ... as
    wide, so none meets more than two of its own level; the other side's shorter ones are dealt to
    those levels too. A pair is made only in the first bin both share, so no pair is made twice and none
    has to be made distinct. Bins with more than ``heavy`` of the shorter rows are split: those are
    dealt by content, and the longer ones go to each split. All joins are by equal keys.

    Both tables are written to shared storage once, as each is read several times.

    Rows with a null key or end, or that end no later than they start, overlap nothing. Repeated rows
    pair each for itself. Right columns get ``prefix``.
    """
    if width < 1:
        raise ValueError("a bin has a width of 1 or more")
    mine, other = (durable(_dealt(*x), "intervals") for x in ((left, left_span, by, width, "left"), (right, right_span, by, width, "right")))
    keys = [f"by{i}" for i in range(len(by))]
    pairs = _half(mine, other, "right", _levels(mine), False, keys, heavy).unionByName(_half(other, mine, "left", _levels(other), True, keys, heavy))
    return pairs.select("left.*", *[F.col("right").getField(c).alias(f"{prefix}{c}") for c in right.columns])
