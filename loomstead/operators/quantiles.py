"""Exact quantiles by group in rounds of counted ranges: no group is sorted or held as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.storage import durable

#: Ranges into which a round cuts what is left of a group.
RANGES = 256
#: Values of one range that a window sorts; more are cut again.
FEW = 10_000


def _wanted(n: str, fraction: float, kind: str):
    """The places, from 0, of the values that make the quantile of ``n`` values."""
    if kind == "disc":
        return F.greatest(F.ceil(F.col(n) * F.lit(fraction)) - 1, F.lit(0)), None
    at = (F.col(n) - 1) * F.lit(fraction)
    return F.floor(at), at - F.floor(at)


def _range(value, low, high):
    """The range of a value from 0 on, never lower for a larger value: ends (and what lies beyond them) have ranges of their own."""
    half = lambda c: c.cast("double") / 2  # noqa: E731  the difference of two huge numbers would be infinite
    share = (half(value) - half(low)) / (half(high) - half(low)) * RANGES
    return F.when(value <= low, 0).when(value >= high, RANGES + 1).otherwise(F.least(F.floor(share), F.lit(RANGES - 1)) + 1)


def exact_quantiles(df: DataFrame, by: tuple[str, ...], value: str, fractions: tuple[float, ...], kind: str = "cont") -> DataFrame:
    """Quantiles of a numeric column: ``by`` columns, ``fraction``, ``n`` (values of the group) and ``quantile``.

    ``disc`` is the least value that as large a share of the group doesn't exceed, of the column's own type;
    ``cont`` is a double, interpolated between the two values about it. Nulls are left out, and groups with
    nothing else. NaN is the largest number. A null in a ``by`` column is a group of its own.

    A round counts, by group and quantile, the values of each range between the bounds that the round before left,
    added up before the shuffle, and keeps the range in which the place lies, with the least and largest of its values as bounds.
    It ends where those are equal, or where so few values are left that a window may sort them. However many rows
    or copies of one value a group has, the shuffle gets a few hundred numbers a group, quantile and task. ``df`` is read
    once a round, two columns of it: write it first where it is dear to make.
    """
    if kind not in ("cont", "disc") or not fractions or not all(0 <= f <= 1 for f in fractions):
        raise ValueError("kind is cont or disc, and fractions are from 0 to 1")
    keys = [f"k{i}" for i in range(max(len(by), 1))]
    held = F.col(f"`{value}`")
    one = F.pmod(F.xxhash64(held), F.lit(1))  # without keys all rows are one group, by a key that stays a key in the plan
    rows = df.select(*[e.alias(k) for e, k in zip([F.col(f"`{c}`") for c in by] or [one], keys, strict=True)], held.alias("v")).where("v is not null")
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    finite = F.abs(F.col("v").cast("double")) < F.lit(float("inf"))
    ends = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.when(finite, F.col("v"))).alias("low"), F.max(F.when(finite, F.col("v"))).alias("high"), F.min("v").alias("least"))
    ends = ends.select(*keys, "n", F.coalesce("low", "least").alias("low"), F.coalesce("high", "least").alias("high"))

    targets = []
    for i, fraction in enumerate(fractions):
        at, share = _wanted("n", fraction, kind)
        for part, place in enumerate((at, at + 1) if kind == "cont" else (at,)):
            targets.append(F.struct(F.lit(i).alias("q"), F.lit(part).alias("part"), F.least(place, F.col("n") - 1).cast("long").alias("place"), (F.lit(None).cast("double") if share is None else share).alias("share")))
    open_ = ends.select("*", F.explode(F.array(*targets)).alias("t")).select(*keys, "n", "low", "high", "t.*", F.lit(0).cast("long").alias("below"), F.lit(True).alias("first"))
    open_ = durable(open_, "quantiles")

    found: list[DataFrame] = []
    while True:
        a, b = rows.alias("a"), open_.alias("b")
        inside = F.col("b.first") | F.col("a.v").between(F.col("b.low"), F.col("b.high"))
        placed = a.join(b, [*same("a", "b"), inside]).select("b.*", "a.v")
        task = [*keys, "q", "part"]
        counts = placed.withColumn("range", _range(F.col("v"), F.col("low"), F.col("high"))).groupBy(*task, "range", "n", "place", "share", "below").agg(F.count("*").alias("here"), F.min("v").alias("low"), F.max("v").alias("high"))
        through = F.col("below") + F.sum("here").over(Window.partitionBy(*task).orderBy("range"))
        held = counts.withColumn("through", through).where("place < through and place >= through - here")
        held = durable(held.select(*task, "n", "low", "high", "place", "share", (F.col("through") - F.col("here")).alias("below"), F.lit(False).alias("first"), "here"), "quantiles")
        found.append(held.where("low <=> high").select(*task, "n", "share", F.col("low").alias("v")))
        few = held.where(~F.col("low").eqNullSafe(F.col("high")) & (F.col("here") <= FEW))
        if not few.isEmpty():
            b = few.alias("b")
            near = a.join(b, [*same("a", "b"), F.col("a.v").between(F.col("b.low"), F.col("b.high"))]).select("b.*", "a.v")
            nth = F.row_number().over(Window.partitionBy(*task).orderBy("v")) - 1 + F.col("below")
            found.append(durable(near.withColumn("nth", nth).where("nth = place").select(*task, "n", "share", "v"), "quantiles"))
        open_ = held.where(~F.col("low").eqNullSafe(F.col("high")) & (F.col("here") > FEW)).drop("here")
        if open_.isEmpty():
            break

    values = found[0]
    for more in found[1:]:
        values = values.unionByName(more)
    both = values.groupBy(*keys, "q", "n").agg(F.max(F.when(F.col("part") == 0, F.col("v"))).alias("v0"), F.max(F.when(F.col("part") == 1, F.col("v"))).alias("v1"), F.max("share").alias("share"))
    low, high = F.col("v0").cast("double"), F.col("v1").cast("double")
    answer = F.col("v0") if kind == "disc" else F.when((F.col("share") == 0) | (low == high), low).otherwise(low + (high - low) * F.col("share"))
    fraction = F.element_at(F.array(*[F.lit(float(f)) for f in fractions]), F.col("q") + 1)
    return both.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=False)], fraction.alias("fraction"), "n", answer.alias("quantile"))
