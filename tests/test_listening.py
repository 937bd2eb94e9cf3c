import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import listening as L
from tidemark.operators import timeseries as T

SF = "/root/testdata/sf0.001"


def exchanges(spark, name):
    return entry.plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("name", ["perception_events", "event_timestamps", "perception_summary"])
def test_perception_meets_once(spark, name):
    """A plan of a hundred exchanges took more memory of the driver than its limit."""
    assert exchanges(spark, name) <= 2


def test_kernel_is_the_series_operators(spark):
    rng = np.random.default_rng(3)
    for k, beats in enumerate([[], [1.0], [1.0, 1.0, 1.0, 4.0], [2.0, 2.5, 3.0, 9.75, 20.0], sorted(rng.uniform(0, 30, 70))]):
        b = spark.createDataFrame([("a", float(x)) for x in beats], "track string, t double")
        g = T.grid(spark.createDataFrame([("a", 30.2)], "track string, duration double"), 0.5)
        at, n = lambda x, c: {r.i: r[c] for r in x.select("i", c).collect()}, 61
        want = at(T.momentum(b, g), "momentum"), at(T.beat_disruption(b, g), "disruption")
        got = L.momentum(np.array(beats), n), L.beat_disruption(np.array(beats), n)
        assert got[0] == pytest.approx([want[0][i] for i in range(n)], abs=1e-12), k
        assert got[1] == pytest.approx([want[1].get(i, 0.0) for i in range(n)], abs=1e-12), k
    for x in ([0.5], [0.0, 0.0, 0.0], list(rng.uniform(0, 1, 7)), list(rng.uniform(0, 1, 90) * (rng.uniform(0, 1, 90) > 0.6))):
        f = spark.createDataFrame([("a", i, i * 0.25, float(v)) for i, v in enumerate(x)], "track string, frame long, t double, v double")
        col = lambda d, c: [r[c] for r in d.orderBy("frame").select(c).collect()]
        x = np.array(x)
        assert L.moving_average(x, 20) == pytest.approx(col(T.moving_average(f, "v", 20, "m"), "m"), abs=1e-12)
        assert L.breath(x) == pytest.approx(col(T.breath(f, "v"), "breath"), abs=1e-9)
        assert L.disruption_of(L.max_normalised(x)) == pytest.approx(col(T.spectral_disruption(f, "v"), "v"), abs=1e-12)
        assert L.silences(x, 0.25) == [tuple(r) for r in T.silences(T.decibels(f, "v")).select("start", "end", "duration", "depth_db").orderBy("start").collect()]
        t = np.arange(50) * 0.5
        g = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(t)], "track string, i long, t double")
        assert L.interpolate(t, np.arange(len(x)) * 0.25, x) == pytest.approx([r.v for r in T.interpolate(g, f, "v").orderBy("i").collect()], abs=1e-12)


def test_odd_tracks(spark):
    none = np.empty(0)
    row = L.heard(None, none, none, none, none, none, none, 0.5, 0.25)
    assert row["events"] == [] and len(row["momentum"]) == 0 and row["mean_momentum"] is None
    row = L.heard(1.2, none, none, none, none, none, none, 0.5, 0.25)
    assert len(row["breath"]) == 3 and row["mean_pattern_lock"] == 1 and not row["silence"].any()


def test_rows_without_time_value_or_user(spark, tmp_path):
    rows = [(1, None, "2024-01-02 00:00:00"), (1, 60.0, None), (1, 70.5, "2024-01-05 00:00:00"), (None, 3.0, "2024-01-05 00:00:00"), (2, 1.0, None)]
    x = spark.createDataFrame(rows, "user_id long, value double, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    x.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.track: r for r in entry.plans.B.listeners_once(spark, str(tmp_path), list(entry.plans.B.LISTENED)).collect()}
    assert sorted(got) == ["u1", "u2"] and got["u1"].beats == [4.0, 16.0] and got["u1"].onsets == [16.0] and got["u1"].centroid == 652.5
    assert got["u1"].f0[8] is None and got["u1"].f0[33] == 196 and len(got["u1"].rms) == 34 and got["u2"].beats == []
    assert entry.plans.QUERIES["perception_events"](spark, str(tmp_path)).where("track = 'u2'").count() == 0


def test_report_rounds_as_its_sql(spark, tmp_path):
    """Two users: a shown decimal that ends in 5 where the product in doubles does not, and one the other way round."""
    x = spark.read.parquet("/root/testdata/sf0.1/events.parquet").where("user_id IN (325, 124)")
    x.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    cur = c.execute(entry.plans.SQL["track_report"])
    names = [d[0] for d in cur.description]
    want = {r[0]: dict(zip(names, r, strict=True)) for r in cur.fetchall()}
    got = {r.track: r.asDict() for r in entry.plans.QUERIES["track_report"](spark, str(tmp_path)).collect()}
    assert got == want and want["u325"]["dynamic_range_ratio"] == 544.42 and want["u124"]["spectral_centroid_mean_hz"] == 511.6


def test_summary_of_tracks_without_length(spark, tmp_path):
    """Users 1, 2 and 4 have no point of the grid (their row is at the start, before it, without a time): they have no summary and stop no other."""
    rows = [(1, 5.0, "2024-01-01 00:00:00"), (2, 5.0, "2023-12-30 00:00:00"), (3, 60.0, "2024-01-01 02:00:00"), (4, 70.5, None), *[(5, 20.0 * k, f"2024-01-{k + 1:02} 07:30:00") for k in range(1, 25)]]
    x = spark.createDataFrame(rows, "user_id long, value double, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    x.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    cur = c.execute(entry.plans.SQL["perception_summary"])
    names = [d[0] for d in cur.description]
    want = {r[0]: dict(zip(names, r, strict=True)) for r in cur.fetchall()}
    got = {r.track: r.asDict() for r in entry.plans.QUERIES["perception_summary"](spark, str(tmp_path)).collect()}
    assert got == want and sorted(got) == ["u3", "u5"]


@pytest.mark.parametrize("name", ["perception_summary", "perception_events", "perception_stream"])
def test_values_that_are_no_numbers(spark, tmp_path, name):
    """NaN counts as larger than any number, in the kernel as in the SQL."""
    rows = [(u, float(v), f"2024-01-{1 + k // 2:02} {k % 2 * 12 + k % 7:02}:10:00") for u, odd in enumerate(["nan", "inf", "-inf", "1e200", "5"]) for k, v in enumerate([*range(20, 180, 8), odd, *range(10, 60, 3)])]
    x = spark.createDataFrame(rows, "user_id long, value double, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    x.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    cur = c.execute(entry.plans.SQL[name])
    names = [d[0] for d in cur.description]
    got = entry.plans.QUERIES[name](spark, str(tmp_path)).select(*[f"`{n}`" for n in names]).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, cur.fetchall()))


def test_report_adds_in_the_tables_order(spark, tmp_path):
    """Users whose mean lies halfway between two shown decimals and one with two equal pitch classes, their rows shuffled over five files of unlike sizes: the last bit of a sum decides, as in the SQL on one thread."""
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute("""CREATE TABLE x AS SELECT * FROM '/root/testdata/sf0.1/events.parquet' WHERE user_id = 713 OR user_id IN (SELECT user_id FROM '/root/testdata/sf0.1/events.parquet' GROUP BY 1
      HAVING (sum(value::DECIMAL(9, 2)) * 100)::BIGINT * 2 % count(*) = 0 AND (sum(value::DECIMAL(9, 2)) * 100)::BIGINT * 2 // count(*) % 2 = 1) ORDER BY hash(event_id)""")
    (tmp_path / "events.parquet").mkdir()
    n, cuts = c.execute("SELECT count(*) FROM x").fetchone()[0], [0, 0.05, 0.3, 0.4, 0.85, 1]
    for k in range(5):
        c.execute(f"COPY (SELECT * FROM x LIMIT {int(n * cuts[k + 1]) - int(n * cuts[k])} OFFSET {int(n * cuts[k])}) TO '{tmp_path}/events.parquet/{k}.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    cur = c.execute(entry.plans.SQL["track_report"])
    names = [d[0] for d in cur.description]
    want = {r[0]: dict(zip(names, r, strict=True)) for r in cur.fetchall()}
    got = {r.track: r.asDict() for r in entry.plans.QUERIES["track_report"](spark, str(tmp_path)).collect()}
    assert len(want) > 2 and got == want


@pytest.mark.parametrize("name", ["perception_summary", "perception_events"])
def test_beats_without_a_time(spark, tmp_path, name):
    """They count among a track's beats as in the SQL: users with 0 to 24 beats and 0 to 3 more without a time."""
    rows = [(10 * u + m, 20.0 + 7 * k, f"2024-01-{1 + k * 28 // max(n, 1):02} {(k * 5 + u) % 24:02}:10:00") for u, n in enumerate([1, 2, 3, 6, 24]) for m in range(4) for k in range(n)]
    rows += [(10 * u + m, 33.0, None) for u in range(6) for m in range(4) for _ in range(m)] + [(None, 3.0, "2024-01-05 00:00:00")]
    x = spark.createDataFrame(rows, "user_id long, value double, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    x.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet' WHERE user_id IS NOT NULL")
    cur = c.execute(entry.plans.SQL[name])
    names = [d[0] for d in cur.description]
    got = entry.plans.QUERIES[name](spark, str(tmp_path)).select(*[f"`{n}`" for n in names]).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, cur.fetchall()))
