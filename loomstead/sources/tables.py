"""Reading and writing tables in Spark's file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Formats that are read with a given schema, never by inference over the data.
FORMATS = ("parquet", "orc", "json", "csv")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """A table in one of ``FORMATS``. Text formats need a schema, so no pass is spent on inferring one."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    if schema is None and kind in ("json", "csv"):
        raise ValueError(f"{kind} is read with a schema")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.format(kind).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Write a table; ``partition_by`` columns become folders that later filters prune."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    writer = df.write.mode(mode).format(kind)
    if kind == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.partitionBy(*partition_by).save(path)


def write_bucketed(df: DataFrame, name: str, keys: tuple[str, ...], buckets: int, mode: str = "errorifexists") -> None:
    """Save a table bucketed and sorted by ``keys``: joins of tables alike in that need no shuffle."""
    df.write.mode(mode).format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
