"""Function surface: vector arithmetic on the JVM side, and Arrow-batched Python functions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: str, b: str) -> Column:
    """Dot product of two arrays of doubles of the same length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    """Cosine of two arrays of doubles; null where either is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


@F.pandas_udf(T.LongType())
def bucket_of(value: pd.Series) -> pd.Series:
    """The ten-wide bucket of a number; null stays null."""
    return (value // 10).astype("Int64")


def value_range(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Spread (largest less least) and count of ``value`` by ``key``, with a mergeable Python state.

    Each task folds its batches into one state a key, so a hot key costs the shuffle one row
    a task. Null values count as rows but don't widen the spread.
    """
    kind = rows.schema[key].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]).append_column("c", pa.array([1] * batch.num_rows, pa.int64()))
            part = table.select(["k", "v", "v", "c"]).rename_columns(["k", "low", "high", "c"])
            part = part if held is None else pa.concat_tables([held, part])
            held = part.group_by("k").aggregate([("low", "min"), ("high", "max"), ("c", "sum")]).rename_columns(["k", "low", "high", "c"])
        if held is not None:
            yield from held.select(["k", "low", "high", "c"]).combine_chunks().to_batches()

    states = rows.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).mapInArrow(fold, f"k {kind}, low double, high double, c long")
    return states.groupBy(F.col("k").alias(key)).agg((F.max("high") - F.min("low")).alias("spread"), F.sum("c").alias("n"))


@F.udtf(returnType=T.StructType([T.StructField("field", T.StringType()), T.StructField("number", T.LongType())]))
class JsonFields:
    """A row for each field of a JSON object whose value is an integer; other texts give none."""

    def eval(self, text: str):
        try:
            found = json.loads(text) if text else None
        except ValueError:
            found = None
        if isinstance(found, dict):
            for field, number in found.items():
                if isinstance(number, int):
                    yield field, number

