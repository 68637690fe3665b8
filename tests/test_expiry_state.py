"""The state function of run expiry, called without Spark."""

import pandas as pd

from corpusloom.operators import events as E


class State:
    hasTimedOut, exists, held, due = False, False, None, None

    def getCurrentWatermarkMs(self):
        return 0

    def update(self, held):
        self.held, self.exists = held, True

    def setTimeoutTimestamp(self, due):
        self.due = due

    @property
    def get(self):
        return self.held


def test_a_run_without_expiry_sends_no_table():
    day, columns = 86_400_000_000, ["first_us", "last_us", "events"]
    follow, state = E._expire(7), State()
    parts = [pd.DataFrame([(2 * day, 3 * day, 2)], columns=columns), pd.DataFrame([(day, day, 1)], columns=columns)]
    assert list(follow(("r",), iter(parts), state)) == [] and state.held == (day, 3 * day, 3)
    later = pd.DataFrame([(10 * day + 1, 10 * day + 1, 1), (10 * day, 10 * day, 1)], columns=columns)
    assert list(follow(("r",), iter([later]), state)) == [] and state.held == (day, 10 * day + 1, 5)
    far = pd.DataFrame([(18 * day, 18 * day, 1)], columns=columns)
    closed = pd.concat(follow(("r",), iter([far]), state))
    assert closed.values.tolist() == [["r", day, 10 * day + 1, 5]] and state.held == (18 * day, 18 * day, 1)
