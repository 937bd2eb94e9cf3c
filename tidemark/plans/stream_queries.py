"""The streaming operators over whole batch tables, with their SQL: what a stream gives once its watermark has passed everything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import table
from ..streaming import streams as ST
from . import bindings as B
from .queries import query, r
from .text_queries import LAP, SEGMENTS


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("track"), "ts", "value", F.col("ts").alias("_t"))


def _shown(c: str):
    return F.date_format(F.col(c).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias(c)


def windows(width: int, hop: int) -> str:
    """SQL of the events in every window of ``width`` hours that starts at a multiple of ``hop``."""
    w, h = width * 3_600_000_000, hop * 3_600_000_000
    return f"""ev AS (SELECT event_type AS track, epoch_us(ts) AS us, value FROM events),
wi AS (SELECT track, us, value, unnest(range((us - {w}) // {h} + 1, us // {h} + 1)) * {h} AS start FROM ev)"""


def centre(width: int) -> str:
    return f"strftime(make_timestamp(start + {width * 1_800_000_000}), '%Y-%m-%d %H:%M:%S') AS centre"


@query(f"WITH {windows(4, 1)} SELECT track, {centre(4)}, round(avg(value), 6) + 0.0 AS mean, count(*)::BIGINT AS n FROM wi GROUP BY track, start")
def stream_sliding(spark, d):
    x = ST.sliding(_events(spark, d), "ts", "value", "4 hours", "1 hour", "1 hour")
    return x.select("track", _shown("centre"), r("mean").alias("mean"), "n")


@query(f"WITH {windows(12, 12)} SELECT track, strftime(make_timestamp(start), '%Y-%m-%d %H:%M:%S') AS start, round(avg(value), 6) + 0.0 AS mean, max(value) AS peak FROM wi GROUP BY track, wi.start")
def stream_tumbling(spark, d):
    x = ST.tumbling(_events(spark, d), "ts", "value", "12 hours", "1 hour")
    return x.select("track", _shown("start"), r("mean").alias("mean"), "peak")


@query("""WITH ev AS (SELECT event_type AS track, epoch_us(ts) AS us FROM events), nw AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY track ORDER BY us) <= 3600000000 THEN 0 ELSE 1 END AS new FROM ev), cl AS (SELECT *, sum(new) OVER (PARTITION BY track ORDER BY us) AS c FROM nw)
SELECT track, strftime(make_timestamp(min(us)), '%Y-%m-%d %H:%M:%S') AS start, strftime(make_timestamp(max(us) + 3600000000), '%Y-%m-%d %H:%M:%S') AS "end", count(*)::BIGINT AS n FROM cl GROUP BY track, c""")
def stream_sessions(spark, d):
    return ST.sessions(_events(spark, d), "ts", "1 hour", "1 hour").select("track", _shown("start"), _shown("end"), "n")


@query(f"""WITH {windows(8, 1)}, gp AS (SELECT track, start, us, us - lag(us) OVER (PARTITION BY track, start ORDER BY us) AS g FROM wi), st AS (SELECT track, start, count(*) AS n, avg(g) / 1e6 AS m, stddev_pop(g / 1e6) AS s FROM gp GROUP BY 1, 2)
SELECT track, {centre(8)}, n::BIGINT AS n, round(CASE WHEN n >= 3 AND m > 0 THEN greatest(0.0, 1 - s / m) * least(1.0, n / greatest(1.0, 28800 / m)) ELSE 0.0 END, 6) + 0.0 AS momentum FROM st""")
def stream_momentum(spark, d):
    x = ST.momentum(_events(spark, d), "ts", "8 hours", "1 hour", "1 hour")
    return x.select("track", _shown("centre"), "n", r("momentum").alias("momentum"))


@query(f"WITH {windows(4, 1)} SELECT track, {centre(4)}, round(CASE WHEN count(*) >= 3 THEN coalesce(regr_slope(value, (us - 1704067200000000) / 1e6), 0.0) * 3600 ELSE 0.0 END, 4) + 0.0 AS direction FROM wi GROUP BY track, start")
def stream_direction(spark, d):
    x = ST.direction(_events(spark, d), "ts", "value", "4 hours", "1 hour", "1 hour")
    return x.select("track", _shown("centre"), r(F.col("direction") * 3600, 4).alias("direction"))


@query("""WITH ev AS (SELECT event_type AS track, epoch_us(ts) / 1e6 AS t, value - 250 AS db FROM events), x AS (SELECT *, db < -40 AS q, lag(db < -40) OVER (PARTITION BY track ORDER BY t) IS DISTINCT FROM (db < -40) AS turn, lead(t) OVER (PARTITION BY track ORDER BY t) AS nxt FROM ev),
rn AS (SELECT *, sum(turn::INT) OVER (PARTITION BY track ORDER BY t) AS run FROM x) SELECT track, round(min(t), 3) AS start, round(max(nxt), 3) AS "end", round(min(db), 6) + 0.0 AS depth_db FROM rn WHERE q GROUP BY track, run HAVING max(coalesce(nxt, 0)) - min(t) >= 7200 AND count(nxt) = count(*)""")
def stream_silence_runs(spark, d):
    """Runs that have ended; the one that is still open at a track's end has not."""
    x = _events(spark, d).select("track", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (F.col("value") - 250).alias("db"))
    zone = F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp")) / 1e6  # the session's own
    out = ST.silence_runs(x.withColumn("t", F.col("t") - zone), -40.0, 7200.0)
    return out.select("track", r("start", 3).alias("start"), r("end", 3).alias("end"), r("depth_db").alias("depth_db"))


@query("""WITH ev AS (SELECT user_id::VARCHAR AS track, event_id::DOUBLE AS t, value / 500 AS m, value / 1000 AS x, (value - 250) / 500 AS b FROM events), p AS (SELECT *, lag(m) OVER w AS pm, lag(b) OVER w AS pb FROM ev WINDOW w AS (PARTITION BY track ORDER BY t)),
f AS (SELECT track, t, CASE WHEN m > 0.8 AND (pm IS NULL OR pm <= 0.8) THEN 'listener_locked' WHEN m < 0.2 AND pm >= 0.2 THEN 'listener_floating' WHEN x > 0.5 THEN 'pattern_break' WHEN b > 0.3 AND pb <= 0.3 THEN 'building' WHEN b < -0.3 AND pb >= -0.3 THEN 'releasing' END AS event FROM p) SELECT * FROM f WHERE event IS NOT NULL""")
def stream_edge_flags(spark, d):
    v = F.col("value")
    x = table(spark, d, "events").select(F.col("user_id").cast("string").alias("track"), F.col("event_id").cast("double").alias("t"), (v / 500).alias("momentum"), (v / 1000).alias("disruption"), ((v - 250) / 500).alias("breath"))
    return ST.edge_flags(x)


@query(f"""WITH RECURSIVE {SEGMENTS}, fo AS (SELECT track, k, seg, w AS acc, w AS novel FROM sg WHERE k = 1 UNION ALL SELECT s.track, s.k, s.seg, list_concat(f.acc, s.w[{LAP.format(a='f.acc', b='s.w')} + 1 :]), s.w[{LAP.format(a='f.acc', b='s.w')} + 1 :] FROM fo f JOIN sg s ON s.track = f.track AND s.k = f.k + 1)
SELECT track::VARCHAR AS track, seg, array_to_string(novel, ' ') AS text FROM fo WHERE len(novel) > 0""")
def stream_captions(spark, d):
    c = B.captions(spark, d).select(F.col("track").cast("string").alias("track"), "seg", "text")
    return ST.rolling_captions(c, 20_000)
