"""Chunked windows against plain Python loops on seeded random series."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from quarte.operators import asof, motion
from quarte.operators.quantiles import middle
from quarte.operators.series import number, overlap_join, runs


def random_series(seed, n=60, gap=0.4):
    r = random.Random(seed)
    return [None if r.random() < gap else round(r.uniform(-1, 1), 3) for _ in range(n)]


@pytest.fixture
def data():
    cases = {k: random_series(k) for k in range(4)}
    cases[4] = [None] * 12
    cases[5] = [0.5]
    cases[6] = [None, None, 0.9, None, None, None, None, None, None]
    cases[7] = [0.9] * 23
    return cases


def frame(spark, data):
    rows = [(k, f, x) for k, xs in data.items() for f, x in enumerate(xs)]
    return spark.createDataFrame(rows, "k int, frame int, x double")


def loop_runs(xs, gap):
    marks = [i for i, x in enumerate(xs) if x is not None and x > 0.2]
    out = []
    for i in marks:
        if out and i - out[-1][1] <= gap:
            out[-1][1] = i
            out[-1][2] += 1
        else:
            out.append([i, i, 1])
    return [tuple(o) for o in out]


@pytest.mark.parametrize("gap", [1, 2])
def test_runs(spark, data, tiny_chunks, gap):
    rows = runs(frame(spark, data), ["k"], "frame", F.col("x") > 0.2, gap=gap).collect()
    got = sorted((r.k, r.start_frame, r.end_frame, r.n_frames) for r in rows)
    assert got == sorted((k, *o) for k, xs in data.items() for o in loop_runs(xs, gap))


def loop_fill(xs, limit):
    known = [i for i, x in enumerate(xs) if x is not None]
    out = []
    for i, x in enumerate(xs):
        b = max((j for j in known if j < i), default=None)
        a = min((j for j in known if j > i), default=None)
        if x is None and b is not None and a is not None and i - b <= limit:
            x = xs[b] + (xs[a] - xs[b]) * (i - b) / (a - b)
        out.append(x)
    return out


def test_interpolation(spark, data, tiny_chunks):
    rows = motion.interpolate_gaps(frame(spark, data), ["k"], "frame", ["x"], 2).collect()
    got = {(r.k, r.frame): r.x for r in rows}
    for k, xs in data.items():
        for f, want in enumerate(loop_fill(xs, 2)):
            assert got[k, f] == (None if want is None else pytest.approx(want))


def test_fill_edges_of_single_and_empty_series(spark, tiny_chunks):
    data = {0: [None, 3.0, None, None], 1: [None, None], 2: [None, 1.0, None, 2.0, None]}
    rows = motion.fill_edges(frame(spark, data), ["k"], "frame", ["x"]).collect()
    got = {(r.k, r.frame): r.x for r in rows}
    assert [got[0, f] for f in range(4)] == [0.0, 3.0, 0.0, 0.0]
    assert [got[1, f] for f in range(2)] == [None, None]
    assert [got[2, f] for f in range(5)] == [1.0, 1.0, 1.5, 2.0, 2.0]


def test_gradient_crosses_chunks(spark, tiny_chunks):
    xs = [float(i * i) for i in range(13)]
    rows = motion.with_gradients(frame(spark, {0: xs}), ["k"], "frame", {"v": "x"}, 1.0).collect()
    got = {r.frame: r.v for r in rows}
    assert got == {0: 1.0, 12: 23.0, **{i: 2.0 * i for i in range(1, 12)}}


def test_steps_skip_gaps(spark, data, tiny_chunks):
    rows = motion.steps_between_present(frame(spark, data), ["k"], "frame", {"d": (("x",), F.col("x").isNotNull())})
    got = {(r.k, r.frame): r.d for r in rows.collect()}
    for k, xs in data.items():
        last = None
        for f, x in enumerate(xs):
            want = None if x is None or last is None else abs(x - last)
            assert got[k, f] == (None if want is None else pytest.approx(want))
            last = x if x is not None else last


def test_middle_is_exact(spark):
    r = random.Random(3)
    values = {0: [r.random() for _ in range(5001)], 1: [r.random() for _ in range(4000)], 2: [1.0, 1.0, 5.0, 5.0], 3: [2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k int, v double")
    got = {x.k: x.m for x in middle(df, ["k"], F.col("v"), "m").collect()}
    up = {x.k: x.m for x in middle(df, ["k"], F.col("v"), "m", upper=True).collect()}
    for k, vs in values.items():
        assert got[k] == pytest.approx(statistics.median(vs), abs=0)
        assert up[k] == sorted(vs)[len(vs) // 2]


def test_number_and_totals(spark, tiny_chunks):
    df = spark.createDataFrame([(k, i * 7 % 50) for k in range(2) for i in range(50)], "k int, t int")
    df = df.withColumn("c", F.expr("t div 4"))
    rows = number(df, ["k"], "c", ["t"], "n", {"low": ("min", F.col("t"))}).collect()
    assert all(r.n == r.t and r.low == 0 for r in rows)


def test_overlap_join(spark, tiny_chunks):
    r = random.Random(5)
    a = [(i, s, s + r.randrange(9)) for i, s in enumerate(r.randrange(40) for _ in range(30))]
    b = [(i, s, s + r.randrange(9)) for i, s in enumerate(r.randrange(40) for _ in range(30))]
    left = spark.createDataFrame([(0, *x) for x in a], "k int, i int, s int, e int")
    right = spark.createDataFrame([(0, *x) for x in b], "k int, j int, u int, w int")
    got = sorted((r.i, r.j) for r in overlap_join(left, right, ["k"], ("s", "e"), ("u", "w")).collect())
    assert got == sorted((i, j) for i, s, e in a for j, u, w in b if s <= w and u <= e)


def test_asof_ties_and_clamps(spark):
    stamps = spark.createDataFrame([(0, 100, 0), (0, 200, 1), (0, 300, 2)], "k int, ts long, frame long")
    points = spark.createDataFrame([(0, t) for t in (50, 100, 150, 151, 200, 350)], "k int, ts long")
    rows = asof.neighbours(points, stamps, ["k"], "ts", "frame", span=60)
    by = lambda mode: {r.ts: r.chosen.frame for r in asof.pick(rows, "ts", mode).collect()}
    assert by("nearest") == {50: 0, 100: 0, 150: 0, 151: 1, 200: 1, 350: 2}
    assert by("previous") == {50: 0, 100: 0, 150: 0, 151: 0, 200: 0, 350: 2}
    assert by("next") == {50: 0, 100: 0, 150: 1, 151: 1, 200: 1, 350: 2}
