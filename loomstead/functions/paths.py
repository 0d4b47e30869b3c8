"""A polymorphic table function: paths through ordered rows of each key, with columns that the pattern decides."""

from __future__ import annotations

from collections import deque

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn


class PathMatches:
    """``path_matches(TABLE(rows), pattern, key, at, id, kind)``: neighbouring rows of a key whose kinds spell the pattern.

    ``pattern`` has kinds joined by ``>``; an asterisk is any kind. Spark deals the rows by ``key`` and sorts them by ``at`` and
    ``id``; only the columns named are sent. A task keeps as many rows as the pattern has steps, however many a key has. Each match
    is a row of the key, and for every step its ``id`` as ``<kind>_<nth>`` (``any_<nth>`` for an asterisk). Matches may
    overlap. A null kind equals none but the asterisk; rows of a null key are a key.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, pattern: AnalyzeArgument, key: AnalyzeArgument, at: AnalyzeArgument, id: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
        steps = [s.strip() for s in (pattern.value or "").split(">")]
        if not rows.isTable or not all(steps):
            raise ValueError("path_matches takes a table and a pattern like 'view>click>*'")
        types = {f.name: f.dataType for f in rows.dataType.fields}
        missing = [a.value for a in (key, at, id, kind) if a.value not in types]
        if missing:
            raise ValueError(f"the table has no column {missing[0]}")
        out = T.StructType([T.StructField(key.value, types[key.value])])
        for nth, step in enumerate(steps, 1):
            out.add(f"{'any' if step == '*' else step}_{nth}", types[id.value])
        names = dict.fromkeys([key.value, at.value, id.value, kind.value])
        return AnalyzeResult(schema=out, partitionBy=[PartitioningColumn(f"`{key.value}`")], orderBy=[OrderingColumn(f"`{at.value}`"), OrderingColumn(f"`{id.value}`")], select=[SelectedColumn(f"`{c}`") for c in names])

    def __init__(self) -> None:
        self.seen: deque = deque()

    def eval(self, rows, pattern: str, key: str, at: str, id: str, kind: str):
        steps = [s.strip() for s in pattern.split(">")]
        self.seen.append((rows[kind], rows[id]))
        if len(self.seen) > len(steps):
            self.seen.popleft()
        if len(self.seen) == len(steps) and all(step in ("*", found) for step, (found, _) in zip(steps, self.seen, strict=True)):
            yield rows[key], *[i for _, i in self.seen]


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register("path_matches", udtf(PathMatches))
