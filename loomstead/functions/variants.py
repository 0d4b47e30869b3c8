"""JSON of no fixed shape as VARIANT columns: parsed once, read by path, with the schema that all rows merge to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(text: str) -> Column:
    """The text as a variant; null for null and for what is no JSON."""
    return F.try_parse_json(text)


def fields(df: DataFrame, text: str, paths: dict[str, tuple[str, str]], name: str = "variant") -> DataFrame:
    """Add a variant column of the JSON in ``text``, and for each name in ``paths`` the value at a path as a type.

    A path that isn't there, or whose value isn't of the type, gives null, as malformed text does; ``malformed`` tells the latter.
    Columns of these names are replaced.
    """
    held = df.withColumn(name, parsed(text)).withColumn("malformed", F.col(text).isNotNull() & F.col(name).isNull())
    return held.withColumns({c: F.try_variant_get(name, path, kind) for c, (path, kind) in paths.items()})


def merged_schema(df: DataFrame, variant: str) -> DataFrame:
    """One row: the ``schema`` that fits all variants of a column; a partial one a task goes through the shuffle."""
    return df.agg(F.schema_of_variant_agg(variant).alias("schema"))
