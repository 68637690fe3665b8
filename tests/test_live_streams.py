"""Streams over several micro-batches: live state, retention, resumed readers; and long runs in slices."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators import events as E
from corpusloom.session import scratch_path
from corpusloom.streaming import logs as S

SCHEMA = "event_id bigint, ts timestamp, run_id string, value double"
START = dt.datetime(2024, 3, 1)


def rows_at(*rows):
    return [(i, START + dt.timedelta(hours=h), run, v) for i, h, run, v in rows]


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream_of(spark, folder):
    return S.read_events(spark, folder, T._parse_datatype_string(SCHEMA))


def test_a_batch_writes_only_the_keys_it_changes(spark):
    root, folder = scratch_path(spark, "live"), scratch_path(spark, "events")
    live, totals, written = E.live_gauge(["run_id"], "value"), [], []
    batches = [
        rows_at(*[(k, 1, f"r{k}", 1.0 * k) for k in range(40)]),
        rows_at((100, 2, "r3", 7.0), (101, 2, "r5", 8.0)),
        rows_at((102, 30, "r3", 9.0)),
        rows_at((103, 31, "r3", 10.0), (99, 29, "r4", 11.0)),
    ]
    for rows in batches:
        deliver(spark, folder, rows)
        got = live.whole(S.live_result(live.parts(stream_of(spark, folder)), live.keys, "t", root, compact_every=3))
        totals.append({r.run_id: r.value for r in got.collect()})
    last = {f"r{k}": 1.0 * k for k in range(40)} | {"r3": 10.0, "r5": 8.0, "r4": 11.0}
    assert totals[-1] == last and totals[1]["r3"] == 7.0 and len(totals[0]) == 40
    for name in sorted(os.listdir(f"{root}/changes"), key=lambda n: int(n.split("=")[1])):
        written.append(spark.read.schema(live.parts(stream_of(spark, folder)).schema).parquet(f"{root}/changes/{name}").count())
    assert [n for n in written if n] == [40, 2, 1, 2]
    assert any(name.startswith("base-") and name != "base-number" for name in os.listdir(root))


@pytest.mark.parametrize("kind", ["counter", "histogram", "states"])
def test_live_figures_equal_the_batch_ones(spark, kind):
    r = random.Random(4)
    rows = sorted(rows_at(*[(k, r.random() * 100, r.choice(["a", "b", None]), r.choice([None, 5.0, 60.0, 1e6])) for k in range(300)]), key=lambda x: x[1])
    root, folder = scratch_path(spark, "live"), scratch_path(spark, "events")
    shape = lambda d: d.selectExpr("*", "run_id AS agent", "CAST(value AS string) AS status", "CAST(event_id AS string) AS error_code")
    live = {
        "counter": E.live_counter(["run_id"]), "histogram": E.live_histogram("value", labels=["run_id"]), "states": E.live_run_states()
    }[kind]
    for part in (rows[:100], rows[100:250], rows[250:]):
        deliver(spark, folder, part)
        got = live.whole(S.live_result(live.parts(shape(stream_of(spark, folder))), live.keys, "t", root))
    every = shape(spark.createDataFrame(rows, SCHEMA))
    if kind == "counter":
        wanted = E.counter(every, ["run_id"])
    elif kind == "histogram":
        wanted, got = E.histogram(every, "value", labels=["run_id"]), E.histogram_rows(got, labels=["run_id"])
    else:
        wanted = E.run_states(every)
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.select(got.columns).collect()))


def test_runs_expire_over_several_resumed_batches(spark):
    root, folder = scratch_path(spark, "expired"), scratch_path(spark, "events")
    day = 24
    batches = [
        rows_at((1, 0, "a", 0.0), (2, 5, "a", 0.0), (3, 0, "b", 0.0), (4, 1, "quiet", 0.0)),
        rows_at((5, 6 * day, "a", 0.0), (6, 9 * day, "b", 0.0), (7, 9 * day, "c", 0.0)),
        rows_at((8, 1.5 * day, "late", 0.0), (9, 14 * day, "c", 0.0)),
        rows_at((10, 40 * day, "z", 0.0)),
    ]
    seen = []
    for rows in batches:
        deliver(spark, folder, rows)
        got = S.append_result(E.expired_runs(stream_of(spark, folder), delay="1 hour"), "expired", root)
        seen.append(sorted((r.run_id, (r.last_ts - START).total_seconds() / 3600, (r.expired_at - r.last_ts).days, r.events) for r in got.collect()))
    assert seen[0] == []
    assert seen[1] == [("b", 0.0, 7, 1), ("quiet", 1.0, 7, 1)]
    assert seen[2] == [*sorted([("a", 6.0 * day, 7, 3), *seen[1]])]
    assert seen[3] == sorted([*seen[2], ("b", 9.0 * day, 7, 1), ("c", 14.0 * day, 7, 2)])


def test_early_stopping_in_slices_and_with_a_long_run(spark):
    r = random.Random(8)
    data = [(k, START + dt.timedelta(seconds=r.randrange(500)), r.choice(["long", "long", "x", "y", None]), r.choice([None, *[100 - k / 9 + r.random() * 30] * 4])) for k in range(900)]
    frame = spark.createDataFrame(data, SCHEMA).repartition(4)
    wanted = {}
    for run in ("long", "x", "y", None):
        best, since = None, 0
        for i, ts, _, v in sorted((d for d in data if d[2] == run and d[3] is not None), key=lambda d: (d[1], d[0])):
            better = best is None or v < best - 0.5
            since = 0 if better else since + 1
            if since >= 6:
                wanted[run] = (i, ts, best)
                break
            best = v if best is None else min(best, v)
    assert wanted
    for slice_rows in (1, 7, 65_536):
        got = E.early_stopping(frame, "value", 6, 0.5, slice_rows=slice_rows).collect()
        assert {x.run_id: (x.stop_event, x.stop_ts, x.best) for x in got} == wanted


def test_curve_middles_among_many_ties(spark):
    data = [(k, START + dt.timedelta(seconds=k // 400), "tied", float(k)) for k in range(1001)] + [(5000 + k, START, "two", 1.0) for k in range(2)]
    got = {(r.run_id, r.place): r.event_id for r in E.curve_sample(spark.createDataFrame(data, SCHEMA).repartition(3), "value").collect()}
    assert got == {("tied", "first"): 0, ("tied", "middle"): 500, ("tied", "last"): 1000, ("two", "first"): 5000, ("two", "last"): 5001}
