"""Joins of streams and timers over several batches with late rows, against plain Python."""

import os
import random
from datetime import timedelta

import pandas as pd
import pytest

from loomstead.streaming import event_time

LATE = timedelta(days=2)


@pytest.fixture(scope="module")
def late_files(spark, sf_dir, tmp_path_factory):
    """The events in three files: some rows come a file late but within two days, two rows come ten days late."""
    folder = tmp_path_factory.mktemp("late") / "events.parquet"
    folder.mkdir()
    rng = random.Random(6)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").toPandas().sort_values("ts").reset_index(drop=True)
    third = len(events) // 3
    part = [min(i // third, 2) for i in range(len(events))]
    for end in (third, 2 * third):
        for i in range(end - 30, end):
            if events["ts"][end - 1] - events["ts"][i] < timedelta(days=1) and rng.random() < 0.5:
                part[i] += 1
    first = events.iloc[:third]
    view = first[first["event_type"] == "view"].iloc[[0]]
    too_late = pd.concat([view.assign(event_id=10**6, event_type="purchase"), view.assign(event_id=10**6 + 1)])
    for k in range(3):
        rows = events[[p == k for p in part]].sample(frac=1, random_state=k)
        rows = pd.concat([rows, too_late]) if k == 2 else rows
        rows.to_parquet(folder / f"{k}.parquet", coerce_timestamps="us", index=False)
        os.utime(folder / f"{k}.parquet", (1_700_000_000 + 10 * k,) * 2)
    assert sum(a > b for a, b in zip(part, part[1:])) > 3
    return str(folder.parent), [tuple(r) for r in events[["user_id", "event_id", "event_type", "ts"]].itertuples(index=False)]


def watermark(events, kinds):
    return min(max(t for _, _, k, t in events if k == kind) for kind in kinds) - LATE


def test_streams_join_like_tables(spark, late_files):
    folder, events = late_files
    views, purchases = ([e for e in events if e[2] == kind] for kind in ("view", "purchase"))
    day, hour = timedelta(days=1), timedelta(hours=1)
    want = sorted((p[0], p[1], v[1]) for p in purchases for v in views if p[0] == v[0] and timedelta(0) <= p[3] - v[3] <= day)
    got = sorted(tuple(r) for r in event_time.viewed_purchases(spark, folder, 1, "2 days").collect())
    assert got == want and want

    end = watermark(events, ("view", "purchase"))
    alone = sorted((p[0], p[1]) for p in purchases if p[3] < end and not any(p[0] == v[0] and timedelta(0) <= p[3] - v[3] <= hour for v in views))
    assert sorted(tuple(r) for r in event_time.unviewed_purchases(spark, folder, 1, "2 days").collect()) == alone and alone


def test_idle_users_are_told_by_timer(spark, late_files):
    folder, events = late_files
    end = max(e[3] for e in events) - LATE
    want = []
    for user in {e[0] for e in events}:
        visits = []
        for t in sorted(e[3] for e in events if e[0] == user):
            if visits and t - visits[-1][-1] < timedelta(days=1):
                visits[-1].append(t)
            else:
                visits.append([t])
        closed = [v for v in visits if v[-1] + timedelta(days=1) <= end]
        want += [(user, nth, v[0].to_pydatetime(), v[-1].to_pydatetime(), len(v)) for nth, v in enumerate(closed, 1)]
    before = spark.conf.get(event_time._PROVIDER)
    got = [tuple(r) for r in event_time.idle_users(spark, folder, 1, "2 days").collect()]
    assert sorted(got) == sorted(want) and want
    assert max(nth for _, nth, *_ in want) > 1
    assert spark.conf.get(event_time._PROVIDER) == before
