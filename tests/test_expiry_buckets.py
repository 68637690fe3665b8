"""Expiry of many runs in one state, against the rule for each run."""

import random
from collections import defaultdict

import pandas as pd
import pytest

from corpusloom.operators import events as E

HOUR = 3_600_000_000


class State:
    def __init__(self):
        self.held, self.due, self.now, self.hasTimedOut = None, None, 0, False

    @property
    def exists(self):
        return self.held is not None

    @property
    def get(self):
        return self.held

    def getCurrentWatermarkMs(self):
        return self.now

    def update(self, held):
        self.held = held

    def setTimeoutTimestamp(self, due):
        assert due > self.now
        self.due = due

    def remove(self):
        self.held = self.due = None


def called(follow, key, parts, state, now):
    """The rows of a call with these parts, or of a timer that is due."""
    state.now, state.hasTimedOut = now, not parts
    if not parts and (state.due is None or state.due > now):
        return []
    return [r for table in follow(key, iter(parts), state) for r in table[["run_id", "first_us", "last_us", "events"]].values.tolist()]


@pytest.mark.parametrize("seed", range(8))
def test_a_bucket_follows_each_run_by_the_rule(seed):
    r = random.Random(seed)
    plain, many = E._expire(7), E._expire_many(7)
    states, state = defaultdict(State), State()
    start = now = 0
    closed = 0
    for step in range(12):
        rows = []
        for _ in range(r.choice([0, 3, 60])):
            first = (start + r.randrange(24 * 6)) * HOUR + r.randrange(HOUR)
            rows.append((f"r{r.randrange(9)}", first, first + r.randrange(HOUR), r.randrange(1, 5)))
            if r.random() < 0.3:  # exactly seven days behind the last, or a little more
                run, _, last, _ = rows[-1]
                rows.append((run, at := last + 7 * 24 * HOUR + r.randrange(2), at, 1))
        columns = ["run_id", "first_us", "last_us", "events"]
        parts = [pd.DataFrame(rows[k : k + 20], columns=columns).assign(bucket=3) for k in range(0, len(rows), 20)]
        got = called(many, (3,), parts, state, now)
        want = []
        for run in sorted({x[0] for x in rows} | set(states)):
            own = [p[p["run_id"] == run] for p in parts]
            want += called(plain, (run,), [p for p in own if len(p)], states[run], now)
        assert sorted(got) == sorted(want), step
        kept = [] if state.held is None else E.pa.ipc.open_stream(state.held[0]).read_all().to_pylist()
        assert {k["run_id"]: (k["first_us"], k["last_us"], k["events"]) for k in kept} == {n: s.held for n, s in states.items() if s.exists}
        assert state.due == min((s.due for s in states.values() if s.exists), default=None)
        closed += len(got)
        start += r.choice([0, 24, 24 * 5, 24 * 20])
        now = max(now, (start - 1) * HOUR // 1000)
    assert closed
