"""Gap filling against a plain walk over the calendar."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomstead.operators.gaps import fill_gaps

T0 = datetime(1969, 12, 31, 20)


def at(h):
    return T0 + timedelta(hours=h)


def walk(points, how, first, last):
    """Values at the hours from first to last, of a dict of hours."""
    out = []
    for h in range(first, last + 1):
        before, after = [x for x in points if x <= h], [x for x in points if x >= h]
        if h in points and how != "line":
            out.append(points[h])
        elif how in ("null", "zero"):
            out.append(None if how == "null" else 0)
        elif how == "before":
            out.append(points[max(before)] if before else None)
        elif how == "after":
            out.append(points[min(after)] if after else None)
        elif not before or not after:
            out.append(None)
        else:
            a, b = max(before), min(after)
            out.append(float(points[a]) if a == b else points[a] + (points[b] - points[a]) * (h - a) / (b - a))
    return out


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("how", ["null", "zero", "before", "after", "line"])
def test_every_fill(spark, kind, how):
    held = {"a": {0: 5, 1: None, 4: 9, 9: 1}, "b": {3: 2}, None: {0: None, 2: 4, 6: None}, "c": {-50: None, -48: None}}
    rows = [(k, at(h), v) for k, points in held.items() for h, v in points.items()] + [("a", None, 3)]
    frame = spark.createDataFrame(rows, "step string, t timestamp, own int").withColumn("t", F.col("t").cast(kind))
    got = {}
    for r in fill_gaps(frame, ("step",), "t", 3600, {"own": how}).collect():
        got.setdefault(r.step, []).append((r.t, r.own, r.filled))
    assert got.keys() == held.keys()
    for k, points in held.items():
        first, last = min(points), max(points)
        values = walk({h: v for h, v in points.items() if v is not None}, how, first, last)
        assert sorted(got[k], key=lambda x: x[0]) == [(at(h), v, h not in points) for h, v in zip(range(first, last + 1), values)]


def test_empty_no_keys_and_refusals(spark):
    frame = spark.createDataFrame([(at(0), 1.0), (at(2), 3.0)], "t timestamp, v double")
    assert [r.v for r in sorted(fill_gaps(frame, (), "t", 3600, {"v": "line"}).collect())] == [1.0, 2.0, 3.0]
    assert fill_gaps(frame.limit(0), (), "t", 3600, {"v": "line"}).collect() == []
    with pytest.raises(ValueError):
        fill_gaps(frame, (), "t", 0, {"v": "line"})
    with pytest.raises(ValueError):
        fill_gaps(frame, (), "t", 1, {"v": "spline"})
