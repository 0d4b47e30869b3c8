"""Sketches kept as columns and merged later: distinct counts (HLL) and quantiles (KLL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Twice the logarithm of the registers: 2 ** 12 of them, a standard error of 1.04 / 64.
REGISTER_BITS = 12
#: Size of a KLL sketch; ranks are within about 1.33 % of the values with 99 % certainty.
KLL_SIZE = 200
DISTINCT_ERROR = 1.04 / (1 << REGISTER_BITS // 2)
RANK_ERROR = 0.0133


def sketch(df: DataFrame, by: dict[str, Column], item: str, value: str) -> DataFrame:
    """A row a group with its ``items`` and ``values`` sketches and its ``n`` rows.

    Sketches are made in each task and merged after the shuffle; each takes a few kilobytes, however
    many rows there are. Nulls are in neither sketch. Store the table and merge it by any coarser groups.
    """
    named = df.select(*[e.alias(c) for c, e in by.items()], F.col(f"`{item}`").alias("i"), F.col(f"`{value}`").cast("double").alias("v"))
    return named.groupBy(*by).agg(F.hll_sketch_agg("i", REGISTER_BITS).alias("items"), F.kll_sketch_agg_double("v", F.lit(KLL_SIZE)).alias("values"), F.count("*").alias("n"))


def merge(sketches: DataFrame, by: dict[str, Column]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones, in any order; ``by`` are expressions of the finer keys."""
    keyed = sketches.select(*[e.alias(c) for c, e in by.items()], "items", "values", "n")
    return keyed.groupBy(*by).agg(F.hll_union_agg("items").alias("items"), F.kll_merge_agg_double("values").alias("values"), F.sum("n").alias("n"))


def distinct() -> Column:
    """About how many different items a group has."""
    return F.hll_sketch_estimate("items")


def quantile(fraction: float) -> Column:
    """A value whose rank is about that share of the group's values; null where it has none."""
    return F.when(F.kll_sketch_get_n_double("values") > 0, F.kll_sketch_get_quantile_double("values", F.lit(fraction)))
