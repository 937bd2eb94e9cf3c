import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalog as K
from tidemark.operators import events as E
from tidemark.operators import timeseries as T
from tidemark.operators.captions import rolling_text
from tidemark.streaming import streams as ST


@pytest.fixture()
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def stream_of(spark, tmp_path, rows, schema, name):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}-ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_sessions_and_sliding(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:{s:02d}", float(s)) for s in (0, 1, 2, 10, 11)] + [("a", "2024-01-01 01:00:00", 0.0)]
    base = spark.createDataFrame(rows, "track string, x string, v double").withColumn("ts", F.col("x").cast("timestamp"))
    base.write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(base.schema).parquet(f"{tmp_path}/in")
    got = run(ST.sessions(src, "ts", "2 seconds", "1 second"), tmp_path, "sess")
    assert sorted(r.n for r in got) == [2, 3]
    got = run(ST.sliding(src, "ts", "v", "4 seconds", "1 second", "1 second"), tmp_path, "slid")
    assert sum(r.n for r in got) == 5 * 4


def test_silence_runs_cross_batches(spark, tmp_path, store):
    parts = [[("a", 0.0, -60.0), ("a", 0.5, -70.0)], [("a", 1.0, -50.0), ("a", 1.5, -10.0), ("a", 2.0, -60.0), ("a", 2.1, 0.0)]]
    got = run(ST.silence_runs(stream_of(spark, tmp_path, parts, "track string, t double, db double", "s")), tmp_path, "runs")
    assert [(r.start, r.end, r.depth_db) for r in got] == [(0.0, 1.5, -70.0)]


def test_edges_and_captions(spark, tmp_path, store):
    rows = [("a", 0.0, 0.9, 0.0, 0.0), ("a", 0.5, 0.95, 0.6, 0.0), ("a", 1.0, 0.1, 0.0, 0.4), ("a", 1.5, 0.9, 0.9, 0.4), ("a", 2.0, 0.5, 0.0, 0.1), ("a", 2.5, 0.5, 0.0, 0.5), ("a", 3.0, 0.5, 0.0, -0.5), ("a", 3.5, 0.5, 0.0, -0.6)]
    schema = "track string, t double, momentum double, disruption double, breath double"
    got = run(ST.edge_flags(stream_of(spark, tmp_path, [rows[:1], rows[1:4], rows[4:]], schema, "e")), tmp_path, "edges")
    batch = E.edge_flags(spark.createDataFrame(rows, schema).withColumn("i", F.col("t"))).where("event IS NOT NULL")
    assert sorted((r.t, r.event) for r in got) == sorted((r.t, r.event) for r in batch.collect())
    assert {r.event for r in got} == {"listener_locked", "listener_floating", "pattern_break", "building", "releasing"}
    texts = ["a b c", "b c d", "d e", "e f g h", "h"]
    got = run(ST.rolling_captions(stream_of(spark, tmp_path, [[("a", i, t)] for i, t in enumerate(texts)], "track string, seg long, text string", "c"), 4), tmp_path, "caps")
    assert " ".join(r.text for r in sorted(got, key=lambda r: r.seg)) == rolling_text(texts)


def test_momentum_direction_and_segments(spark, tmp_path):
    """A stream's windows against the batch operators at the same centres."""
    times = [0.0, 1.0, 2.1, 3.0, 4.2, 5.0, 6.0, 7.3, 20.0, 21.0]
    base = spark.createDataFrame([("a", f"2024-01-01 00:00:{s:06.3f}", s, float(i * i)) for i, s in enumerate(times)] + [("a", "2024-01-01 01:00:00", 3600.0, 0.0)], "track string, x string, t double, v double")
    base = base.withColumn("ts", F.col("x").cast("timestamp"))
    base.write.parquet(f"{tmp_path}/in")
    src = lambda: spark.readStream.schema(base.schema).parquet(f"{tmp_path}/in")
    beats = base.where("t < 100").select("track", "t")
    points = T.grid(spark.createDataFrame([("a", 30.0)], "track string, duration double"), 1.0)
    want = {r.t: (r.n, r.momentum) for r in T.momentum(beats, points, 8.0, 1.0).collect()}
    start = base.selectExpr("min(ts)").first()[0]
    got = {(r.centre - start).total_seconds(): r for r in run(ST.momentum(src(), "ts", "8 seconds", "1 second", "1 second"), tmp_path, "mom")}
    assert len(got) > 20
    for t, r in got.items():
        if t >= 0 and r.n > 1:
            assert (r.n, r.momentum) == (want[t][0], pytest.approx(want[t][1]))
    got = {(r.centre - start).total_seconds(): r.direction for r in run(ST.direction(src(), "ts", "v", "4 seconds", "1 second", "1 second"), tmp_path, "dir")}
    inside = [(s, i * i) for i, s in enumerate(times) if 0 <= s < 4]
    assert got[2.0] == pytest.approx(np.polyfit(*zip(*inside), 1)[0])
    got = {(r.start - start).total_seconds(): (r["mean"], r.peak) for r in run(ST.tumbling(src(), "ts", "v", "10 seconds", "1 second"), tmp_path, "tum")}
    assert got[0.0] == (np.mean([i * i for i in range(8)]), 49.0) and got[20.0] == (72.5, 81.0)


def test_catalog_sink(spark, tmp_path):
    src = stream_of(spark, tmp_path, [[("a", 1.0)], [("a", 2.0), ("b", 3.0)]], "track string, m double", "k")
    ST.catalog_sink(src, f"{tmp_path}/cat", f"{tmp_path}/cat-ck").awaitTermination(120)
    last = K.load(spark, f"{tmp_path}/cat")
    assert {r.track for r in last.collect()} == {"a", "b"} and last.count() == 2
