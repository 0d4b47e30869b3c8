"""Sketches, variants and paths on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from loomstead.functions import paths, sketches, variants


def test_sketches_merge_in_any_order(spark):
    frame = spark.range(60_000).select((F.col("id") % 24).alias("hour"), (F.col("id") * 7919 % 20_000).alias("item"), F.when(F.col("id") % 5 > 0, F.sqrt("id")).alias("value"))
    hours = sketches.sketch(frame, {"hour": F.col("hour")}, "item", "value").cache()
    first = sketches.merge(hours.orderBy("hour"), {})
    halves = sketches.merge(hours, {"half": F.col("hour") % 2})
    turned = sketches.merge(halves.orderBy(F.desc("half")), {})
    exact = sorted(r.value for r in frame.where("value is not null").select("value").collect())
    for merged in (first, turned):
        about, middle, n = merged.select(sketches.distinct(), sketches.quantile(0.5), "n").first()
        assert n == 60_000
        assert abs(about - 20_000) <= 3 * sketches.DISTINCT_ERROR * 20_000
        assert abs(sum(v <= middle for v in exact) / len(exact) - 0.5) <= 2 * sketches.RANK_ERROR
    assert first.select(sketches.distinct()).first() == turned.select(sketches.distinct()).first()


def test_sketches_of_nothing(spark):
    frame = spark.createDataFrame([("a", None, None), ("a", None, None)], "k string, item long, value double")
    got = sketches.merge(sketches.sketch(frame, {"k": F.col("k")}, "item", "value"), {"k": F.col("k")}).select(sketches.distinct().alias("d"), sketches.quantile(0.5).alias("q"), "n").collect()
    assert [tuple(r) for r in got] == [(0, None, 2)]
    assert sketches.sketch(frame.limit(0), {"k": F.col("k")}, "item", "value").collect() == []


def test_variants_of_any_shape(spark):
    texts = ['{"k": 1, "t": {"a": [1, 2, {"b": "x"}]}}', '{"k": "no number", "t": {"a": []}}', '{"k": 2.5}', "[1, 2]", "7", "null", '{"k": ', "", None, '{"k": 9007199254740993}']
    frame = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "i int, j string, malformed string")
    found = variants.fields(frame, "j", {"k": ("$.k", "long"), "b": ("$.t.a[2].b", "string"), "first": ("$[0]", "int")})
    rows = {r.i: r for r in found.drop("variant").collect()}
    assert {i: r.k for i, r in rows.items() if r.k is not None} == {0: 1, 2: 2, 9: 9007199254740993}
    assert {i: r.b for i, r in rows.items() if r.b is not None} == {0: "x"}
    assert {i: r["first"] for i, r in rows.items() if r["first"] is not None} == {3: 1}
    assert {i for i, r in rows.items() if r.malformed} == {6, 7}
    assert variants.merged_schema(found.where("i in (0, 1)"), "variant").first().schema == "OBJECT<k: VARIANT, t: OBJECT<a: ARRAY<VARIANT>>>"
    assert variants.merged_schema(found.where("i in (2, 9)"), "variant").first().schema.startswith("OBJECT<k: DECIMAL")


def run_paths(spark, rows, pattern):
    paths.register(spark)
    frame = spark.createDataFrame(rows, "u string, t int, e long, k string, `a b` int")
    return spark.sql(f"SELECT * FROM path_matches(TABLE({{rows}}), '{pattern}', 'u', 't', 'e', 'k')", rows=frame)


def test_paths_decide_their_columns(spark):
    rows = [("x", t, 10 + t, k, 0) for t, k in enumerate("aabab")] + [("y", 0, 1, "a", 0), ("y", 0, 2, "b", 0), (None, 1, 3, "a", 0), (None, 2, 4, "b", 0), ("z", 1, 5, "a", 0), ("z", 2, 6, None, 0)]
    found = run_paths(spark, rows, "a>b")
    assert found.columns == ["u", "a_1", "b_2"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("x", 11, 12), ("x", 13, 14), ("y", 1, 2), (None, 3, 4)], key=str)
    wild = run_paths(spark, rows, "a > * > b")
    assert wild.columns == ["u", "a_1", "any_2", "b_3"] and [tuple(r) for r in wild.collect()] == [("x", 10, 11, 12)]
    assert [tuple(r)[1:] for r in run_paths(spark, rows, "*").where("u = 'z'").collect()] == [(5,), (6,)]
    assert run_paths(spark, [rows[0]], "a>b").collect() == []


def test_patterns_that_are_refused(spark):
    with pytest.raises(Exception, match="pattern"):
        run_paths(spark, [("x", 1, 1, "a", 0)], "a>>b")
