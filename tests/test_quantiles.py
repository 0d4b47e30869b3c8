"""Exact quantiles against sorted lists."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loomstead.operators import quantiles

FRACTIONS = (0.0, 0.1, 0.5, 0.95, 1.0)


def expected(values, f, kind):
    order = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
    if kind == "disc":
        return order[max(math.ceil(len(order) * f) - 1, 0)]
    at = (len(order) - 1) * f
    low, high = float(order[int(at)]), float(order[min(int(at) + 1, len(order) - 1)])
    return low if at == int(at) or low == high else low + (high - low) * (at - int(at))


def groups(rng):
    return {
        "spread": [rng.lognormvariate(0, 9) for _ in range(400)], "copies": [7.0] * 300 + [8.0] * 3, "one": [3.5], "ends": [1e308, -1e308, 0.0, 5e-324, -5e-324, 1.0] * 20,
        "odd": [float("inf"), float("-inf"), float("nan"), 1.0, 2.0, None, 3.0] * 15, "infinite": [float("inf")] * 40 + [float("nan")] * 41, None: [float(i) for i in range(50)], "none": [None, None],
    }


@pytest.mark.parametrize("few", [1, 10_000])
@pytest.mark.parametrize("kind", ["cont", "disc"])
def test_doubles(spark, monkeypatch, few, kind):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "RANGES", 8)
    made = groups(random.Random(4))
    frame = spark.createDataFrame([(k, v, "x") for k, vs in made.items() for v in vs], "range string, v double, low string").repartition(3)
    fractions = FRACTIONS if few > 1 else (0.5,)
    got = {(r.range, r.fraction): (r.n, r.quantile) for r in quantiles.exact_quantiles(frame, ("range",), "v", fractions, kind).collect()}
    assert got.keys() == {(k, f) for k in made if k != "none" for f in fractions}
    for (k, f), (n, q) in got.items():
        want = expected(made[k], f, kind)
        assert n == sum(v is not None for v in made[k])
        assert q == want or (q != q and want != want), (k, f)


def test_other_types_two_keys_and_none(spark):
    rows = [(i % 3, i % 2, (i * 7919) % 1000 + 2**60, Decimal(i * 31 % 97) / 4) for i in range(600)]
    frame = spark.createDataFrame(rows, "a int, b int, v long, d decimal(10,2)")
    got = {(r.a, r.b): r.quantile for r in quantiles.exact_quantiles(frame, ("a", "b"), "v", (0.3,), "disc").collect()}
    assert got == {(a, b): expected([r[2] for r in rows if r[:2] == (a, b)], 0.3, "disc") for a in range(3) for b in range(2)}
    assert [r.quantile for r in quantiles.exact_quantiles(frame, (), "d", (0.5,), "disc").collect()] == [expected([r[3] for r in rows], 0.5, "disc")]
    assert quantiles.exact_quantiles(frame.limit(0), ("a",), "v", (0.5,)).collect() == []
    assert quantiles.exact_quantiles(frame.select("a", F.lit(None).cast("int").alias("v")), ("a",), "v", (0.5,)).collect() == []
    with pytest.raises(ValueError):
        quantiles.exact_quantiles(frame, ("a",), "v", (1.5,))


def test_plans_without_nested_loops(spark, monkeypatch):
    """Without keys, too, rows meet their bounds by an equal join."""
    plans = []
    own = quantiles.durable

    def seen(frame, name):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return own(frame, name)

    monkeypatch.setattr(quantiles, "durable", seen)
    quantiles.exact_quantiles(spark.range(100), (), "id", (0.5,)).collect()
    assert len(plans) > 1 and not any("NestedLoop" in p or "Cartesian" in p for p in plans)
