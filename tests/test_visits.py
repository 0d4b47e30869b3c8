"""What a user's visits cost in calls from Python to the JVM, each of which is a round trip."""

from collections import Counter

import pandas as pd

from loomstead.streaming.event_time import Visits

DAY = 86_400


class Calls:
    """State and timers in memory that count every call."""

    def __init__(self):
        self.n, self.value, self.rows, self.timers = Counter(), {}, {}, set()

    def getValueState(self, name, schema):  # noqa: N802
        return Value(self, name)

    def getMapState(self, name, key, value):  # noqa: N802
        return Rows(self)

    def registerTimer(self, at):  # noqa: N802
        self.n["timer"] += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.n["timer"] += 1
        self.timers.discard(at)


class Value:
    def __init__(self, calls, name):
        self.calls, self.name = calls, name

    def exists(self):
        self.calls.n["state"] += 1
        return self.name in self.calls.value

    def get(self):
        self.calls.n["state"] += 1
        return self.calls.value.get(self.name)

    def update(self, new):
        self.calls.n["state"] += 1
        self.calls.value[self.name] = new


class Rows:
    def __init__(self, calls):
        self.calls = calls

    def iterator(self):
        self.calls.n["state"] += 1
        return iter(list(self.calls.rows.items()))

    def updateValue(self, key, value):  # noqa: N802
        self.calls.n["state"] += 1
        self.calls.rows[key] = value

    def removeKey(self, key):  # noqa: N802
        self.calls.n["state"] += 1
        self.calls.rows.pop(key, None)


class Moment:
    def __init__(self, at):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: at


def test_calls_of_a_user_do_not_grow_with_visits():
    visits, calls = Visits(DAY), Calls()
    visits.init(calls)
    at = [d * 2 * DAY * 1_000_000 + k for d in range(30) for k in range(3)]
    list(visits.handleInputRows((7,), iter([pd.DataFrame({"at": at})]), Moment(0)))
    end, told = 50 * DAY * 1000, []
    while due := sorted(t for t in calls.timers if t <= end):
        calls.timers.discard(due[0])
        now = Moment(due[0])
        now.getCurrentWatermarkInMs = lambda: end
        told += list(visits.handleExpiredTimer((7,), now, now))
    got = pd.concat(told)
    assert got["nth"].tolist() == list(range(1, 26)) and got["start"].tolist() == at[:75:3] and got["n"].tolist() == [3] * 25
    assert calls.timers and min(calls.timers) > end
    assert sum(calls.n.values()) <= 10
