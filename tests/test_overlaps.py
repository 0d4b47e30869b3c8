"""Overlaps counted in tiles against a nested loop, and against the rows a join of all pairs would make."""

import random
from collections import defaultdict

import pytest

from loomstead.operators.overlaps import overlap_counts
from loomstead.plans import timeline

SCHEMA = "k string, s long, e long"


def disjoint(rng, keys, longest):
    rows = []
    for key in range(keys):
        at = rng.randrange(-300, 300)
        for _ in range(rng.randrange(1, 9)):
            end = at + rng.choice([1, 1, 2, rng.randrange(1, longest)])
            rows.append((f"k{key}", at, end))
            at = end + rng.choice([0, 1, rng.randrange(200)])
    return rows + [(None, 0, 10), ("a", None, 10), ("a", 0, None), ("b", 5, 5), ("b", 9, 3), ("far", 10**9, 10**9 + 1)]


@pytest.mark.parametrize(("keys", "longest", "block"), [(60, 12, 1 << 15), (150, 40, 7), (90, 300, 64), (1, 9, 5), (0, 9, 5)])
def test_counts_equal_a_nested_loop(spark, keys, longest, block):
    rows = disjoint(random.Random(keys), keys, longest)
    ok = [r for r in rows if None not in r and r[1] < r[2]]
    want = defaultdict(list)
    for a in ok:
        for b in ok:
            if a[0] != b[0] and a[1] < b[2] and b[1] < a[2]:
                want[a[0]].append(b[0])
    got = overlap_counts(spark.createDataFrame(rows, SCHEMA).repartition(3), "k", ("s", "e"), block).collect()
    assert sorted(tuple(r) for r in got) == sorted((k, len(v), len(set(v))) for k, v in want.items())


def test_intervals_of_a_key_that_overlap_are_refused(spark):
    with pytest.raises(Exception, match="overlap each other"):
        overlap_counts(spark.createDataFrame([("a", 0, 5), ("a", 4, 6), ("b", 0, 1)], SCHEMA), "k", ("s", "e")).collect()


def test_sessions_are_not_paired_in_rows(spark, sf_dir):
    plan = timeline.overlapping_sessions(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Expand" not in plan
