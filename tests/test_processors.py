"""Timed processors on buckets of keys: results of every key, and calls into state that don't follow the keys."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from quarte.streaming import processors as ps

KEYS = 300


class State:
    """A list state that counts its calls."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def get(self):
        self.calls += 1
        return iter(list(self.rows))

    def put(self, rows):
        self.calls += 1
        self.rows = list(rows)

    def appendValue(self, row):
        self.calls += 1
        self.rows.append(row)

    def clear(self):
        self.calls += 1
        self.rows = []


class Handle:
    def __init__(self):
        self.states, self.timers, self.calls = {}, set(), 0

    def getListState(self, name, schema):
        return self.states.setdefault(name, State())

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


def run(processor, batches, delay):
    """Output of a bucket given micro-batches of rows (key, ts, kind, idx), then the end; and the calls into state."""
    handle, out, mark = Handle(), [], 0
    for rows in [*batches, None]:
        processor.init(handle)
        if rows is not None:
            given = pd.DataFrame(rows, columns=["key", "ts", "kind", "idx"])
            list(processor.handleInputRows((1,), iter([given]), None))
        values = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)  # noqa: B023
        for t in sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(t)
            out += list(processor.handleExpiredTimer((1,), values, SimpleNamespace(getExpiryTimeInMs=lambda: t)) or [])  # noqa: B023
        mark = 10**12 if rows is None else max(r[1] for r in rows) - delay
    processor.init(handle)
    values = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)
    for t in sorted(handle.timers):
        out += list(processor.handleExpiredTimer((1,), values, SimpleNamespace(getExpiryTimeInMs=lambda: t)) or [])  # noqa: B023
    calls = handle.calls + sum(s.calls for s in handle.states.values())
    rows = [tuple(None if v is pd.NA or v != v else v for v in r) for o in out for r in o.itertuples(index=False, name=None)]
    return sorted(rows, key=str), calls


def batches(kinds):
    """Three stretches of time with rows of many keys."""
    draw = np.random.default_rng(5)
    rows = [(int(draw.integers(KEYS)), int(t), int(draw.choice(kinds)), i) for i, t in enumerate(np.sort(draw.integers(1000, 9000, 3000)))]
    return rows, [rows[k : k + 1000] for k in (0, 1000, 2000)]


@pytest.mark.parametrize("idle", (500, 10**6))
def test_routing_of_many_matches_takes_few_calls(idle):
    """a match had calls into state of its own."""
    rows, parts = batches([0, 0, 0, 0, 1, 2])
    if idle < 10**5:  # every match lives in one stretch
        parts = [[(k * 3 + n, t, kind, i) for k, t, kind, i in part] for n, part in enumerate(parts)]
        rows = [r for part in parts for r in part]
        parts = [sorted(part) for part in parts]
        idle = 9000
    got, calls = run(ps.Routing(idle), parts, 100)
    kinds = {}
    for k, _, kind, _ in rows:
        kinds.setdefault(k, set()).add(kind)
    assert got == sorted(((k, i) for k, _, _, i in rows if 1 in kinds[k] and 2 not in kinds[k]), key=str) and got
    assert calls < 40 < KEYS


def test_results_of_many_users_take_few_calls():
    """a user had calls into state of its own, and a timer for every open round."""
    limit = 300
    rows, parts = batches([0, 1])
    got, calls = run(ps.ResultTimer(limit), parts, 50)
    want = []
    for k, t, kind, i in rows:
        if kind == ps.ResultTimer.END:
            after = [(u, j) for key, u, what, j in rows if key == k and what == 1 and u >= t]
            wait, result = (min(after)[0] - t, min(after)[1]) if after else (None, None)
            if wait is not None and wait <= limit:
                want.append((k, i, "in_time", result, wait))
            else:
                want.append((k, i, "timeout", None, None))
                want += [(k, i, "backfill", result, wait)] if after else []
    assert got == sorted(want, key=str)
    assert calls < 80 < KEYS


def test_nearest_frames_of_many_users_take_few_calls():
    """a user had calls into state of its own."""
    bound = 400
    rows, parts = batches([0, 1])
    got, calls = run(ps.Nearest(bound), parts, 50)
    want = []
    for k, t, kind, i in rows:
        if kind == ps.Nearest.SIGNAL:
            near = [(abs(u - t), u, j) for key, u, what, j in rows if key == k and what == 0 and abs(u - t) <= bound]
            want.append((k, i, min(near)[2] if near else None))
    assert got == sorted(want, key=str)
    assert calls < 80 < KEYS
