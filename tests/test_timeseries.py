import math
import time

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import timeseries as T


def frame(spark, rows, schema="track string, t double"):
    return spark.createDataFrame(rows, schema)


def brute_momentum(beats, t, w=8.0):
    x = np.array([b for b in beats if t - w / 2 <= b < t + w / 2])
    if len(x) < 3:
        return 0.0
    d = np.diff(x)
    m = d.mean()
    return max(0.0, 1 - d.std() / m) * min(1.0, len(x) / max(1.0, w / m)) if m > 0 else 0.0


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 400), min_size=0, max_size=40, unique=True))
def test_momentum_is_brute_force(spark, ticks):
    beats = sorted(x / 16 for x in ticks)
    b = frame(spark, [("a", x) for x in beats])
    g = T.grid(frame(spark, [("a", 26.0)], "track string, duration double"), 0.5)
    got = {r.t: r.momentum for r in T.momentum(b, g).collect()}
    assert len(got) == 52
    for t, m in got.items():
        assert m == pytest.approx(brute_momentum(beats, t), abs=1e-9) and 0 <= m <= 1


def test_half_open_windows(spark):
    x = T.in_windows(frame(spark, [("a", 2.0)]), 1.0, 1.0, 0.5)
    assert sorted(r.i for r in x.collect()) == [3, 4, 5, 6]  # t_i - 1 <= 2 < t_i + 1


@pytest.mark.parametrize("n, size", [(30, 20), (5, 20), (9, 8), (1, 10), (12, 5)])
def test_moving_average_mirrors(spark, n, size):
    v = [math.sin(i) * 3 + i for i in range(n)]
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "track string, frame long, x double")
    got = [r.m for r in T.moving_average(df, "x", size, "m").orderBy("frame").collect()]
    pad = np.pad(v, (size // 2 + n, size + n), mode="symmetric")
    want = [pad[n + i : n + i + size].mean() for i in range(n)]
    assert np.allclose(got, want)


def test_interpolation_is_numpy(spark):
    rng = np.random.default_rng(1)
    knots = np.sort(rng.uniform(1, 9, 12))
    vals = rng.normal(size=12)
    k = spark.createDataFrame([("a", float(t), float(v)) for t, v in zip(knots, vals)] + [("a", 5.05, None)], "track string, t double, v double")
    g = T.grid(frame(spark, [("a", 10.0)], "track string, duration double"), 0.5)
    got = [r.v for r in T.interpolate(g, k, "v").orderBy("i").collect()]
    assert np.allclose(got, np.interp(np.arange(20) * 0.5, knots, vals))


def test_silences_follow_the_state_machine(spark):
    rng = np.random.default_rng(3)
    loud = rng.random(80) > 0.5
    loud[-3:] = False
    rows = [("a", i * 0.25, 0.0 if q else -60.0 - i) for i, q in enumerate(loud)]
    want, start = [], None
    for i, q in enumerate(loud):
        if not q and start is None:
            start = i
        if q and start is not None:
            want.append((start * 0.25, i * 0.25))
            start = None
    if start is not None:
        want.append((start * 0.25, 79 * 0.25))
    got = T.silences(spark.createDataFrame(rows, "track string, t double, db double"), least=0.5).orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(a, b) for a, b in want if b - a >= 0.5]


def test_clusters_include_the_gap(spark):
    x = T.clusters(frame(spark, [("a", 0.0), ("a", 2.0), ("a", 4.01), ("b", 0.0)]))
    assert [(r.track, r.t, r.cluster) for r in x.orderBy("track", "t").collect()] == [("a", 0.0, 1), ("a", 2.0, 1), ("a", 4.01, 2), ("b", 0.0, 1)]


def test_in_silence_is_closed(spark):
    g = T.grid(frame(spark, [("a", 4.0)], "track string, duration double"), 0.5)
    s = spark.createDataFrame([("a", 1.0, 2.0, 1.0, -50.0)], "track string, start double, end double, duration double, depth_db double")
    assert [r.t for r in T.in_silence(g, s).where("silence").orderBy("i").collect()] == [1.0, 1.5, 2.0]


def test_regularity(spark):
    b = frame(spark, [("even", i * 0.5) for i in range(9)] + [("one", 1.0)])
    got = {r.track: r.beat_regularity for r in T.regularity(b).collect()}
    assert got == {"even": pytest.approx(1.0), "one": 0.0}


def test_empty_series(spark):
    none = frame(spark, [])
    assert T.clusters(none).count() == 0 and T.regularity(none).count() == 0
    assert T.momentum(none, T.grid(none.groupBy("track").agg(F.max("t").alias("duration")), 0.5)).count() == 0


def test_neighbours_in_a_long_track(spark):
    """A hundred thousand rows of one track, both ways: a sort in each direction, nothing quadratic."""
    n = 100_000
    rows = spark.range(n).select(F.lit("a").alias("track"), (F.col("id") * 1.5).alias("t"), F.col("id").cast("double").alias("v"))
    points = spark.range(n).select(F.lit("a").alias("track"), F.col("id").alias("i"), F.col("id").cast("double").alias("t"))
    began = time.time()
    x = T.neighbours(points, rows, ["v"])
    off = x.where((F.col("_back.v") != F.floor(F.col("t") / 1.5)) | (F.col("_ahead.v") != F.ceil(F.col("t") / 1.5)))
    assert x.count() == n and off.count() == 0 and time.time() - began < 60
    strict = T.asof(points.where("i < 10"), rows.where("t < 20"), "v", strict=True)
    assert [r.v for r in strict.orderBy("i").collect()] == [None, 0, 1, 1, 2, 3, 3, 4, 5, 5]


def test_several_values_share_a_pass(spark):
    rows = spark.createDataFrame([("a", i, i * 0.5, float(i), float(-i)) for i in range(9)], "track string, frame long, t double, x double, y double")
    m = T.moving_average(rows, ["x", "y"], 4, ["mx", "my"]).collect()
    assert all(r.mx == -r.my for r in m) and len(m) == 9
    g = T.grid(frame(spark, [("a", 3.0)], "track string, duration double"), 0.25)
    assert all(r.x == -r.y == r.t * 2 for r in T.interpolate(g, rows, ["x", "y"]).collect())
