"""One query per relational operator over the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import harmony as H
from ..functions import scalar as S
from ..operators import captions as C
from ..operators import catalog as K
from ..operators import events as E
from ..operators import timeseries as T
from ..operators.overtones import match_harmonics
from ..session import table
from . import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def r(c, n: int = 6) -> Column:
    return F.round(c, n) + F.lit(0.0)


def points(beats: DataFrame, hop: float = 0.5) -> DataFrame:
    return T.grid(B.durations(beats), hop)


# ---- shared SQL parts -------------------------------------------------------------------------------------------
HOURS = "beats AS (SELECT event_type AS track, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS t, value FROM events)"
GRID = "grid AS (SELECT track, i, i * 0.5::DOUBLE AS t FROM (SELECT track, unnest(range(0, ceil(max(t) / 0.5)::BIGINT)) AS i FROM beats GROUP BY track))"
MOMENTUM = """ib AS (SELECT track, t, lag(t) OVER (PARTITION BY track ORDER BY t) AS t0 FROM beats),
mo AS (SELECT track, i, count(*) + 1 AS n, avg(d) AS m, stddev_pop(d) AS s FROM (
    SELECT track, t - t0 AS d, unnest(range(greatest(0, floor((t - 4.0) / 0.5)::BIGINT + 1), floor((t0 + 4.0) / 0.5)::BIGINT + 1)) AS i FROM ib WHERE t0 IS NOT NULL) GROUP BY track, i),
stream AS (SELECT g.track, g.i, g.t, coalesce(n, 0) AS n,
    CASE WHEN n >= 3 AND m > 0 THEN greatest(0.0, 1 - s / m) * least(1.0, n / greatest(1.0, 8.0 / m)) ELSE 0.0 END AS momentum
  FROM grid g LEFT JOIN mo USING (track, i))"""
FRAMES = """fr0 AS (SELECT track, floor(t)::BIGINT AS frame, sqrt(avg(value * value)) AS rms FROM beats GROUP BY 1, 2),
frames AS (SELECT track, frame, frame::DOUBLE AS t, coalesce(rms, 0.0) AS rms FROM (SELECT track, unnest(range(0, max(frame) + 1)) AS frame FROM fr0 GROUP BY track) LEFT JOIN fr0 USING (track, frame))"""
SILENCE = """dbs AS (SELECT track, t, greatest(-80.0, 20 * log10(greatest(rms, 1e-5)) - 20 * log10(greatest(max(rms) OVER (PARTITION BY track), 1e-5))) AS db FROM frames),
turns AS (SELECT *, db < -40 AS q, lag(db < -40) OVER (PARTITION BY track ORDER BY t) IS DISTINCT FROM (db < -40) AS turn, lead(t) OVER (PARTITION BY track ORDER BY t) AS nxt FROM dbs),
runs AS (SELECT *, sum(turn::INT) OVER (PARTITION BY track ORDER BY t) AS run FROM turns),
sil AS (SELECT track, round(min(t), 2) AS "start", round(max(coalesce(nxt, t)), 2) AS "end", round(max(coalesce(nxt, t)) - min(t), 2) AS duration, round(min(db), 1) AS depth_db
  FROM runs WHERE q GROUP BY track, run HAVING max(coalesce(nxt, t)) - min(t) >= 1.5)"""


def fold(col: str, size: int, src: str, out: str) -> str:
    """SQL of the mirrored moving average of ``src`` (track, frame, col)."""
    return f"""{out} AS (SELECT f.track, f.frame, avg(g.{col}) AS v FROM (SELECT track, frame, count(*) OVER (PARTITION BY track) AS n, unnest(range(-{size // 2}, {size - size // 2})) AS d FROM {src}) f
  JOIN {src} g ON g.track = f.track AND g.frame = CASE WHEN ((f.frame + f.d) % (2 * n) + 2 * n) % (2 * n) < n THEN ((f.frame + f.d) % (2 * n) + 2 * n) % (2 * n) ELSE 2 * n - 1 - ((f.frame + f.d) % (2 * n) + 2 * n) % (2 * n) END GROUP BY f.track, f.frame)"""


CHROMA = """vec AS (SELECT label::BIGINT AS track, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding FROM embeddings),
ch AS (SELECT track, frame, (p % 12)::BIGINT AS pc, sum(abs(embedding[p + 1])::DOUBLE) AS e FROM vec, range(60) AS x(p) GROUP BY 1, 2, 3)"""
KK = """maj AS (SELECT * FROM (VALUES (0, 6.35), (1, 2.23), (2, 3.48), (3, 2.33), (4, 4.38), (5, 4.09), (6, 2.52), (7, 5.19), (8, 2.39), (9, 3.66), (10, 2.29), (11, 2.88)) AS v(j, w)),
minr AS (SELECT * FROM (VALUES (0, 6.33), (1, 2.68), (2, 3.52), (3, 5.38), (4, 2.60), (5, 3.53), (6, 2.54), (7, 4.75), (8, 3.98), (9, 2.69), (10, 3.34), (11, 3.17)) AS v(j, w)),
kk AS (SELECT k AS root, 'major' AS mode, 2 * k AS ord, (j + k) % 12 AS pc, w::DOUBLE AS w FROM maj, range(12) AS x(k) UNION ALL SELECT k, 'minor', 2 * k + 1, (j + k) % 12, w::DOUBLE FROM minr, range(12) AS x(k)),
names AS (SELECT unnest(range(12)) AS root, unnest(['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B']) AS key)"""
CAT = """cat AS (SELECT l_suppkey AS track, round(avg(l_quantity), 6) AS mean_quantity, round(avg(l_extendedprice), 6) AS mean_price, round(avg(l_discount), 6) AS mean_discount, max(l_quantity) AS max_quantity, count(*)::DOUBLE AS lines FROM lineitem GROUP BY 1),
long AS (UNPIVOT cat ON mean_quantity, mean_price, mean_discount, max_quantity, lines INTO NAME metric VALUE value)"""


# ---- rhythm and grid --------------------------------------------------------------------------------------------
@query(f"WITH {HOURS}, {GRID}, {MOMENTUM} SELECT track, i, t, n::BIGINT AS n, round(momentum, 6) + 0.0 AS momentum FROM stream")
def momentum_grid(spark, d):
    b = B.hours(spark, d)
    return T.momentum(b, points(b)).withColumn("momentum", r("momentum")).withColumn("n", F.col("n").cast("long"))


@query(f"WITH {HOURS}, x AS (SELECT track, t - lag(t) OVER (PARTITION BY track ORDER BY t) AS d FROM beats) SELECT track, round(coalesce(greatest(0.0, 1 - stddev_pop(d) / avg(d)), 0.0), 6) + 0.0 AS beat_regularity FROM x GROUP BY track")
def beat_regularity(spark, d):
    return T.regularity(B.hours(spark, d)).withColumn("beat_regularity", r("beat_regularity"))


BEAT = """o AS (SELECT track, t, row_number() OVER (PARTITION BY track ORDER BY t) AS k, t - lag(t) OVER (PARTITION BY track ORDER BY t) AS d, lag(t) OVER (PARTITION BY track ORDER BY t) AS t0 FROM beats),
bt AS (SELECT track, count(*) AS total FROM beats GROUP BY track),
e AS (SELECT track, i, avg(d) AS e FROM (SELECT track, d, unnest(range(greatest(0, floor(t / 0.5)::BIGINT + 1), floor((t0 + 5.0) / 0.5)::BIGINT + 1)) AS i FROM o WHERE t0 IS NOT NULL) GROUP BY track, i),
p AS (SELECT g.track, g.i, g.t, o.t AS prev, coalesce(o.k, 0) AS before FROM grid g ASOF LEFT JOIN o ON o.track = g.track AND g.t > o.t),
f AS (SELECT g.track, g.i, o.t AS next FROM grid g ASOF LEFT JOIN o ON o.track = g.track AND g.t <= o.t),
bd AS (SELECT track, i, t, CASE WHEN total <= 2 THEN 0.0
  WHEN e IS NULL THEN CASE WHEN before > 3 AND t - prev > 1.5 THEN least(1.0, (t - prev) / 5.0) ELSE 0.0 END
  WHEN e > 0 THEN CASE WHEN next < t + 2 * e THEN least(1.0, abs(next - prev - e) / e) ELSE 0.5 END ELSE 0.0 END AS disruption
FROM p JOIN f USING (track, i) JOIN bt USING (track) LEFT JOIN e USING (track, i))"""


@query(f"WITH {HOURS}, {GRID}, {BEAT} SELECT track, i, t, round(disruption, 6) + 0.0 AS disruption FROM bd")
def beat_disruption(spark, d):
    b = B.hours(spark, d)
    return T.beat_disruption(b, points(b)).withColumn("disruption", r("disruption"))


@query(f"""WITH {HOURS}, {FRAMES}, df AS (SELECT track, frame, coalesce(abs(lead(rms) OVER (PARTITION BY track ORDER BY frame) - rms), 0.0) AS v FROM frames), {fold('v', 20, 'df', 'sm')},
x AS (SELECT df.track, df.frame, greatest(0.0, df.v - sm.v) AS v FROM df JOIN sm USING (track, frame))
SELECT track, frame, round(CASE WHEN max(v) OVER (PARTITION BY track) > 0 THEN v / max(v) OVER (PARTITION BY track) ELSE v END, 6) + 0.0 AS disruption FROM x""")
def energy_disruption(spark, d):
    return T.energy_disruption(B.frames(spark, d), "rms", "disruption").select("track", "frame", r("disruption").alias("disruption"))


def _breath(frames: DataFrame) -> DataFrame:
    return T.breath(frames, "rms").select("track", "frame", "t", "breath")


BREATH = f"""{fold('rms', 40, 'frames', 'sm')},
gr AS (SELECT track, frame, coalesce((lead(v) OVER w - lag(v) OVER w) / 2, lead(v) OVER w - v, v - lag(v) OVER w, 0.0) AS g FROM sm WINDOW w AS (PARTITION BY track ORDER BY frame)),
br AS (SELECT track, frame, CASE WHEN max(abs(g)) OVER (PARTITION BY track) > 0 THEN g / max(abs(g)) OVER (PARTITION BY track) ELSE g END AS breath FROM gr)"""


@query(f"WITH {HOURS}, {FRAMES}, {BREATH} SELECT track, frame, round(breath, 6) + 0.0 AS breath FROM br")
def breath(spark, d):
    return _breath(B.frames(spark, d)).select("track", "frame", r("breath").alias("breath"))


@query(f"""WITH {HOURS}, {FRAMES}, {BREATH} SELECT track, round(avg((round(breath, 6) > 0.05)::INT) * 100, 4) + 0.0 AS building, round(avg((round(breath, 6) < -0.05)::INT) * 100, 4) + 0.0 AS releasing, round(avg((abs(round(breath, 6)) <= 0.05)::INT) * 100, 4) + 0.0 AS sustaining FROM br GROUP BY track""")
def breath_distribution(spark, d):
    b = r("breath")
    share = lambda c, n: r(F.avg(c.cast("int")) * 100, 4).alias(n)
    return _breath(B.frames(spark, d)).groupBy("track").agg(share(b > 0.05, "building"), share(b < -0.05, "releasing"), share(F.abs(b) <= 0.05, "sustaining"))


@query(f"WITH {HOURS}, {FRAMES}, {fold('rms', 20, 'frames', 'sm')} SELECT track, frame, round(v, 6) + 0.0 AS smooth FROM sm")
def moving_average_reflect(spark, d):
    return T.moving_average(B.frames(spark, d), "rms", 20, "smooth").select("track", "frame", r("smooth").alias("smooth"))


def _silences(spark, d):
    return T.silences(T.decibels(B.frames(spark, d), "rms"), -40.0, 1.5)


@query(f"WITH {HOURS}, {FRAMES}, {SILENCE} SELECT * FROM sil")
def silence_islands(spark, d):
    return _silences(spark, d)


@query(f"""WITH {HOURS}, {FRAMES}, {SILENCE}, {GRID}, {MOMENTUM},
fl AS (SELECT s.*, EXISTS (SELECT 1 FROM sil WHERE sil.track = s.track AND sil."start" <= s.t AND s.t <= sil."end") AS quiet FROM stream s)
SELECT f.track, round(avg(momentum), 6) + 0.0 AS mean_momentum, round(coalesce(avg(momentum) FILTER (WHERE NOT quiet), avg(momentum)), 6) + 0.0 AS mean_momentum_active,
  round(coalesce(max(momentum) FILTER (WHERE NOT quiet), max(momentum)), 6) + 0.0 AS max_momentum_active, count(*) FILTER (WHERE quiet)::BIGINT AS quiet_points,
  round(coalesce((SELECT sum(duration) FROM sil WHERE sil.track = f.track), 0.0), 1) + 0.0 AS total_silence FROM fl f GROUP BY f.track""")
def active_stats(spark, d):
    b = B.hours(spark, d)
    quiet = _silences(spark, d)
    x = T.momentum(b, points(b)).join(T.in_silence(points(b), quiet).select("track", "i", "silence"), ["track", "i"])
    on = lambda c: F.when(~F.col("silence"), c)
    agg = x.groupBy("track").agg(
        r(F.avg("momentum")).alias("mean_momentum"), r(F.coalesce(F.avg(on(F.col("momentum"))), F.avg("momentum"))).alias("mean_momentum_active"),
        r(F.coalesce(F.max(on(F.col("momentum"))), F.max("momentum"))).alias("max_momentum_active"), F.count_if("silence").alias("quiet_points"),
    )
    total = quiet.groupBy("track").agg(F.sum("duration").alias("_d"))
    return agg.join(total, "track", "left").withColumn("total_silence", r(F.coalesce("_d", F.lit(0.0)), 1)).drop("_d")


SHIFTS = """m AS (SELECT track, i, t, round(momentum, 6) + 0.0 AS momentum FROM stream), nx AS (SELECT *, lead(momentum) OVER (PARTITION BY track ORDER BY i) AS nxt FROM m),
shifts AS (SELECT track, t AS time, CASE WHEN nxt - momentum < -0.05 THEN 'momentum_drop' ELSE 'momentum_gain' END AS type, abs(nxt - momentum) AS intensity, momentum AS "from", nxt AS "to" FROM nx WHERE abs(nxt - momentum) > 0.05)"""


def _shifts(spark, d):
    b = B.hours(spark, d)
    return E.momentum_shifts(T.momentum(b, points(b)).select("track", "i", "t", r("momentum").alias("momentum")), 0.05)


@query(f'WITH {HOURS}, {GRID}, {MOMENTUM}, {SHIFTS} SELECT track, time, type, round(intensity, 6) + 0.0 AS intensity, "from", "to" FROM shifts')
def momentum_shifts(spark, d):
    return _shifts(spark, d).withColumn("intensity", r("intensity"))


EVENTS = f"""{SHIFTS}, {FRAMES}, {SILENCE},
un AS (SELECT track, time, type, round(intensity, 6) + 0.0 AS intensity, NULL::DOUBLE AS duration, NULL::DOUBLE AS depth_db, "from", "to" FROM shifts
  UNION ALL SELECT track, "start", 'silence', 1.0, duration, depth_db, NULL, NULL FROM sil)"""


def _union(spark, d) -> DataFrame:
    quiet = _silences(spark, d).select("track", F.col("start").alias("time"), F.lit("silence").alias("type"), F.lit(1.0).alias("intensity"), "duration", "depth_db")
    return _shifts(spark, d).withColumn("intensity", r("intensity")).unionByName(quiet, allowMissingColumns=True)


@query(f"""WITH {HOURS}, {GRID}, {MOMENTUM}, {EVENTS} SELECT track, count(*) FILTER (WHERE type = 'pattern_break')::BIGINT AS pattern_break, count(*) FILTER (WHERE type = 'momentum_drop')::BIGINT AS momentum_drop,
count(*) FILTER (WHERE type = 'momentum_gain')::BIGINT AS momentum_gain, count(*) FILTER (WHERE type = 'silence')::BIGINT AS silence FROM un GROUP BY track""")
def event_counts(spark, d):
    return _union(spark, d).groupBy("track").agg(*[F.count_if(F.col("type") == k).alias(k) for k in E.TYPES])


CLUSTERS = """cl AS (SELECT *, sum(new) OVER (PARTITION BY track ORDER BY time, type) AS cluster FROM (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY track ORDER BY time, type) <= 2 THEN 0 ELSE 1 END AS new FROM un))"""


def _clusters(spark, d) -> DataFrame:
    return T.clusters(_union(spark, d).withColumnRenamed("time", "t"), 2.0)


@query(f"WITH {HOURS}, {GRID}, {MOMENTUM}, {EVENTS}, {CLUSTERS} SELECT track, cluster::BIGINT AS cluster, count(*)::BIGINT AS n, min(time) AS first, max(time) AS last FROM cl GROUP BY track, cluster")
def event_clusters(spark, d):
    return _clusters(spark, d).groupBy("track", "cluster").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


BEST = f"""{CLUSTERS}, best AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY track, cluster ORDER BY (type = 'silence') DESC, CASE WHEN type = 'silence' THEN duration ELSE intensity END DESC, time, type) = 1)"""


@query(f'WITH {HOURS}, {GRID}, {MOMENTUM}, {EVENTS}, {BEST} SELECT track, cluster::BIGINT AS cluster, time AS t, type, intensity FROM best')
def cluster_best(spark, d):
    return E.best_of_clusters(_clusters(spark, d)).select("track", "cluster", "t", "type", "intensity")


SCORE = """CASE WHEN type = 'silence' THEN 2.0 * (0.4 * least(1.0, abs(coalesce(depth_db, -80.0)) / 80) + 0.6 * least(1.0, coalesce(duration, 0.0) / 10)) ELSE 0.8 * least(1.0, abs("to" - "from")) END"""


@query(f'WITH {HOURS}, {GRID}, {MOMENTUM}, {EVENTS} SELECT track, time, type, round({SCORE}, 6) + 0.0 AS score FROM un')
def event_score(spark, d):
    s = E.event_score(*[F.col(c) for c in ("type", "intensity", "duration", "depth_db", "from", "to")])
    return _union(spark, d).select("track", "time", "type", r(s).alias("score"))


@query(f'WITH {HOURS}, {GRID}, {MOMENTUM}, {EVENTS} SELECT track, time AS t, type, round({SCORE}, 6) + 0.0 AS score, row_number() OVER (PARTITION BY track ORDER BY time)::BIGINT AS place FROM (SELECT * FROM un QUALIFY row_number() OVER (PARTITION BY track ORDER BY {SCORE} DESC, time) <= 4)')
def select_events(spark, d):
    return E.select_events(_union(spark, d).withColumnRenamed("time", "t")).select("track", "t", "type", r("score").alias("score"), "place")


def _plan(spark, d, target=12):
    b = B.hours(spark, d)
    return E.select_frames(E.best_of_clusters(_clusters(spark, d)), B.durations(b), target)


# ---- energy and report ------------------------------------------------------------------------------------------
@query(f"""WITH {HOURS}, {FRAMES}, x AS (SELECT *, count(*) OVER (PARTITION BY track) // 10 AS len FROM frames)
SELECT track, (frame // len)::BIGINT AS segment, round(avg(rms), 6) + 0.0 AS mean_energy, round(max(rms), 6) + 0.0 AS peak_energy FROM x WHERE frame // len < 10 GROUP BY 1, 2""")
def energy_arc(spark, d):
    x = B.frames(spark, d).withColumn("_len", F.floor(F.count("*").over(Window.partitionBy("track")) / 10))
    x = x.withColumn("segment", F.when(F.col("_len") > 0, F.floor(F.col("frame") / F.greatest("_len", F.lit(1)))).otherwise(F.lit(0)).cast("long")).where("segment < 10")
    return x.groupBy("track", "segment").agg(r(F.avg("rms")).alias("mean_energy"), r(F.max("rms")).alias("peak_energy"))


@query(f"WITH {HOURS}, {FRAMES} SELECT track, round(max(rms) / min(rms) FILTER (WHERE rms > 0), 6) + 0.0 AS dynamic_range FROM frames GROUP BY track")
def dynamic_range(spark, d):
    return B.frames(spark, d).groupBy("track").agg(r(F.max("rms") / F.min(F.when(F.col("rms") > 0, F.col("rms")))).alias("dynamic_range"))


@query(f"WITH {HOURS} SELECT track, round(count(*) / max(t), 6) + 0.0 AS onsets_per_unit FROM beats GROUP BY track")
def onset_rate(spark, d):
    return B.hours(spark, d).groupBy("track").agg(r(F.count("*") / F.max("t")).alias("onsets_per_unit"))


@query("""SELECT p_partkey, CASE WHEN p_size / 50.0 > 0.9 THEN 'metronomic' WHEN p_size / 50.0 > 0.7 THEN 'steady' WHEN p_size / 50.0 > 0.5 THEN 'loose' ELSE 'free' END AS rhythm,
CASE WHEN p_size / 50.0 > 0.6 THEN 'percussive' WHEN p_size / 50.0 > 0.45 THEN 'balanced' WHEN p_size / 50.0 > 0.35 THEN 'melodic-rhythmic' WHEN p_size / 50.0 > 0.2 THEN 'melodic' ELSE 'harmonic' END AS character,
CASE WHEN p_retailprice > 3000 THEN 'bright' WHEN p_retailprice > 2000 THEN 'balanced' WHEN p_retailprice > 1200 THEN 'warm' ELSE 'dark' END AS brightness,
CASE WHEN p_size > 50 THEN 'extreme' WHEN p_size > 20 THEN 'wide' WHEN p_size > 5 THEN 'moderate' ELSE 'compressed' END AS dynamics,
CASE WHEN p_size > 5 THEN 'dense' WHEN p_size > 2 THEN 'moderate' WHEN p_size > 0.5 THEN 'sparse' ELSE 'minimal' END AS texture FROM part""")
def label_ladders(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", S.rhythm_label(size / 50.0).alias("rhythm"), S.character_label(size / 50.0).alias("character"), S.brightness_label(F.col("p_retailprice")).alias("brightness"), S.dynamics_label(size).alias("dynamics"), S.texture_label(size).alias("texture"))


@query("""SELECT o_orderkey, round(CASE WHEN o_totalprice / 1e5 + 0.01 > 0.005 THEN (0.01 - o_totalprice / 1e5) / (o_totalprice / 1e5 + 0.01) ELSE 0.0 END, 6) + 0.0 AS hp, round(0.01 / (o_totalprice / 1e5 + 0.01), 6) + 0.0 AS percussion_ratio FROM orders""")
def hp_balance(spark, d):
    h, p = F.col("o_totalprice") / 1e5, F.lit(0.01)
    return table(spark, d, "orders").select("o_orderkey", r(S.hp_balance(h, p, 0.005)).alias("hp"), r(S.percussion_ratio(h, p)).alias("percussion_ratio"))


# ---- joins on time ----------------------------------------------------------------------------------------------
@query(f"WITH {HOURS}, {GRID} SELECT g.track, g.i, g.t, b.t AS at, b.value FROM grid g ASOF LEFT JOIN beats b ON g.track = b.track AND g.t >= b.t")
def asof_value(spark, d):
    b = B.hours(spark, d)
    return T.asof(points(b), b, "value").withColumnRenamed("_at", "at")


@query(f"""WITH {HOURS}, {GRID}, {FRAMES}, a AS (SELECT g.track, g.i, g.t, f.t AS t0, f.rms AS v0 FROM grid g ASOF LEFT JOIN frames f ON g.track = f.track AND g.t >= f.t),
b AS (SELECT a.*, f.t AS t1, f.rms AS v1 FROM a ASOF LEFT JOIN frames f ON a.track = f.track AND a.t <= f.t)
SELECT track, i, t, round(coalesce(v0 + (v1 - v0) * (t - t0) / nullif(t1 - t0, 0), v0, v1), 6) + 0.0 AS rms FROM b""")
def interp_grid(spark, d):
    b = B.hours(spark, d)
    return T.interpolate(points(b), B.frames(spark, d), "rms").withColumn("rms", r("rms"))


# ---- melody -----------------------------------------------------------------------------------------------------
PITCH = "pitch AS (SELECT track, t, CASE WHEN value >= 20 THEN 12 * log2((55 + 2 * value) / 440.0) + 69 END AS midi, CASE WHEN value >= 20 THEN 55 + 2 * value END AS f0, least(1.0, value / 100) AS prob FROM beats)"


def within(width: float, cond: str = "TRUE") -> str:
    return f"SELECT *, unnest(range(greatest(0, floor((t - {width / 2}) / 0.5)::BIGINT + 1), floor((t + {width / 2}) / 0.5)::BIGINT + 1)) AS i FROM pitch WHERE {cond}"


@query(f"""WITH {HOURS}, {GRID}, {PITCH}, x AS ({within(2.0, 'midi IS NOT NULL')}), a AS (SELECT track, i, CASE WHEN count(*) >= 3 THEN regr_slope(midi, t) ELSE 0.0 END AS direction FROM x GROUP BY 1, 2)
SELECT track, i, t, round(coalesce(direction, 0.0), 6) + 0.0 AS direction FROM grid LEFT JOIN a USING (track, i)""")
def contour_direction(spark, d):
    p = B.pitches(spark, d)
    a = T.in_windows(p.where("midi IS NOT NULL"), 1.0, 1.0, 0.5).groupBy("track", "i").agg(F.when(F.count("*") >= 3, F.regr_slope("midi", "t")).otherwise(0.0).alias("direction"))
    return points(p).join(a, ["track", "i"], "left").select("track", "i", "t", r(F.coalesce("direction", F.lit(0.0))).alias("direction"))


@query(f"""WITH {HOURS}, {GRID}, {PITCH}, x AS ({within(4.0, 'midi IS NOT NULL')}), a AS (SELECT track, i, CASE WHEN count(*) >= 2 THEN max(midi) - min(midi) ELSE 0.0 END AS range, CASE WHEN count(*) >= 2 THEN median(midi) END AS centre FROM x GROUP BY 1, 2)
SELECT track, i, t, round(coalesce(range, 0.0), 6) + 0.0 AS range, round(centre, 6) + 0.0 AS centre FROM grid LEFT JOIN a USING (track, i)""")
def pitch_range(spark, d):
    p = B.pitches(spark, d)
    two = F.count("*") >= 2
    a = T.in_windows(p.where("midi IS NOT NULL"), 2.0, 2.0, 0.5).groupBy("track", "i").agg(F.when(two, F.max("midi") - F.min("midi")).otherwise(0.0).alias("range"), F.when(two, F.median("midi")).alias("centre"))
    return points(p).join(a, ["track", "i"], "left").select("track", "i", "t", r(F.coalesce("range", F.lit(0.0))).alias("range"), r("centre").alias("centre"))


@query(f"WITH {HOURS}, {GRID}, {PITCH}, x AS ({within(2.0)}), a AS (SELECT track, i, avg(prob) AS prob FROM x GROUP BY 1, 2) SELECT track, i, t, round(coalesce(prob, 0.0), 10) + 0.0 AS prob FROM grid LEFT JOIN a USING (track, i)")
def presence(spark, d):
    p = B.pitches(spark, d)
    return T.window_average(p, points(p), "prob", 2.0, 0.5).withColumn("prob", r("prob", 10))


@query(f"WITH {HOURS}, {PITCH} SELECT track, round(max(midi) - min(midi), 6) + 0.0 AS range_semitones, round(median(f0), 6) + 0.0 AS median_hz, count(midi)::BIGINT AS voiced FROM pitch GROUP BY track")
def melody_summary(spark, d):
    return B.pitches(spark, d).groupBy("track").agg(r(F.max("midi") - F.min("midi")).alias("range_semitones"), r(F.median("f0")).alias("median_hz"), F.count("midi").alias("voiced"))


@query("""WITH x AS (SELECT p_partkey, p_retailprice AS hz, round_even(12 * log2(p_retailprice / 440.0) + 69, 0)::BIGINT AS m FROM part)
SELECT p_partkey, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][m % 12 + 1] || (m // 12 - 1)::VARCHAR AS note FROM x""")
def note_names(spark, d):
    return table(spark, d, "part").select("p_partkey", S.hz_to_note(F.col("p_retailprice")).alias("note"))


@query("SELECT p_partkey, round(1200 * log2(p_retailprice / 440.0), 6) + 0.0 AS cents FROM part")
def cents(spark, d):
    return table(spark, d, "part").select("p_partkey", r(S.hz_to_cents(F.lit(440.0), F.col("p_retailprice"))).alias("cents"))


# ---- harmony ----------------------------------------------------------------------------------------------------
@query(f"""WITH {CHROMA}, p AS (SELECT track, frame, e / sum(e) OVER (PARTITION BY track, frame) AS p FROM ch)
SELECT track, frame, round(greatest(0.0, 1 + sum(p * log2(p + 1e-10)) / log2(12.0)), 6) + 0.0 AS alignment FROM p GROUP BY track, frame""")
def consonance_temperament(spark, d):
    return B.chroma(spark, d).select("track", "frame", r(H.temperament(F.col("chroma"))).alias("alignment"))


@query(f"""WITH {CHROMA}, a AS (SELECT * FROM ch QUALIFY e > 0.1 * max(e) OVER (PARTITION BY track, frame)), w AS (SELECT unnest(range(12)) AS gap, unnest([1.0, 0.30, 0.50, 0.75, 0.80, 0.90, 0.25, 0.95, 0.65, 0.70, 0.50, 0.40]::DOUBLE[]) AS c),
p AS (SELECT x.track, x.frame, x.e * y.e AS w, w.c FROM a x JOIN a y ON x.track = y.track AND x.frame = y.frame AND x.pc < y.pc JOIN w ON w.gap = y.pc - x.pc)
SELECT a.track, a.frame, round(CASE WHEN count(*) = 1 THEN 1.0 ELSE (SELECT sum(p.w * p.c) / sum(p.w) FROM p WHERE p.track = a.track AND p.frame = a.frame) END, 6) + 0.0 AS consonance FROM a GROUP BY a.track, a.frame""")
def consonance_series(spark, d):
    return B.chroma(spark, d).select("track", "frame", r(H.series(F.col("chroma"))).alias("consonance"))


KEYS = """sc AS (SELECT track, frame, ord, root, mode, round(corr(e, w), 10) AS r FROM src JOIN kk USING (pc) GROUP BY ALL), bk AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY track, frame ORDER BY r DESC, ord) = 1)"""


@query(f"WITH {CHROMA}, {KK}, src AS (SELECT * FROM ch), {KEYS} SELECT track, frame, key, mode, round(greatest(0.0, r), 4) + 0.0 AS confidence FROM bk JOIN names USING (root)")
def key_detection(spark, d):
    return B.chroma(spark, d).select("track", "frame", H.detect_key(F.col("chroma")).alias("k")).select("track", "frame", "k.key", "k.mode", r("k.confidence", 4).alias("confidence"))


@query(f"WITH {CHROMA}, {KK}, src AS (SELECT track, 0 AS frame, pc, avg(e) AS e FROM ch GROUP BY track, pc), {KEYS} SELECT track, key, mode, round(greatest(0.0, r), 4) + 0.0 AS confidence FROM bk JOIN names USING (root)")
def global_key(spark, d):
    mean = B.chroma(spark, d).groupBy("track").agg(F.array(*[F.avg(F.col("chroma")[p]) for p in range(12)]).alias("chroma"))
    return mean.select("track", H.detect_key(F.col("chroma")).alias("k")).select("track", "k.key", "k.mode", r("k.confidence", 4).alias("confidence"))


@query(f"WITH {CHROMA}, m AS (SELECT track, pc, avg(e) AS e FROM ch GROUP BY 1, 2) SELECT track, pc, row_number() OVER (PARTITION BY track ORDER BY e DESC, pc)::BIGINT AS place, round(e, 6) + 0.0 AS energy FROM m QUALIFY place <= 3")
def dominant_chroma(spark, d):
    m = B.chroma(spark, d).select("track", F.posexplode("chroma").alias("pc", "e")).groupBy("track", F.col("pc").cast("long").alias("pc")).agg(F.avg("e").alias("e"))
    return m.withColumn("place", F.row_number().over(Window.partitionBy("track").orderBy(F.desc("e"), "pc")).cast("long")).where("place <= 3").select("track", "pc", "place", r("e").alias("energy"))


@query(f"""WITH {CHROMA}, nx AS (SELECT track, frame, pc, e, lead(e) OVER (PARTITION BY track, pc ORDER BY frame) AS f FROM ch),
d AS (SELECT track, frame, greatest(0.0, 1 - sum(e * f) / (sqrt(sum(e * e)) * sqrt(sum(f * f)))) AS dist FROM nx WHERE f IS NOT NULL GROUP BY 1, 2),
g AS (SELECT track, unnest(range(0, ceil(max(frame) * 0.25 / 0.5)::BIGINT)) AS i FROM d GROUP BY track),
x AS (SELECT track, dist, unnest(range(greatest(0, floor((frame * 0.25 - 4.0) / 0.5)::BIGINT + 1), floor((frame * 0.25 + 4.0) / 0.5)::BIGINT + 1)) AS i FROM d), a AS (SELECT track, i, avg(dist) AS v FROM x GROUP BY 1, 2)
SELECT track, i, round(coalesce(v, 0.0) / max(coalesce(v, 0.0)) OVER (PARTITION BY track), 6) + 0.0 AS flux FROM g LEFT JOIN a USING (track, i)""")
def chroma_flux(spark, d):
    c = B.chroma(spark, d).withColumn("_n", F.lead("chroma").over(T.by_track("frame"))).where("_n IS NOT NULL")
    c = c.select("track", "t", H.cosine_distance(F.col("chroma"), F.col("_n")).alias("flux"))
    return T.max_normalised(T.window_average(c, points(c), "flux", 8.0, 0.5), "flux").select("track", "i", r("flux").alias("flux"))


@query(f"""WITH {CHROMA}, cn AS (SELECT track, frame, pc, e / sum(e) OVER (PARTITION BY track, frame) AS p FROM ch),
tz AS (SELECT track, frame, j, sum(p * round(CASE WHEN j // 2 = 2 THEN 0.5 ELSE 1.0 END * CASE WHEN j % 2 = 0 THEN sin([7 * pi() / 6, 3 * pi() / 2, 2 * pi() / 3][(j // 2 + 1)::INT] * pc) ELSE cos([7 * pi() / 6, 3 * pi() / 2, 2 * pi() / 3][(j // 2 + 1)::INT] * pc) END, 12)) AS v FROM cn, range(6) AS x(j) GROUP BY 1, 2, 3),
nx AS (SELECT *, lead(v) OVER (PARTITION BY track, j ORDER BY frame) AS w FROM tz)
SELECT track, frame, round(coalesce(sqrt(sum((w - v) * (w - v))), 0.0), 6) + 0.0 AS velocity FROM nx GROUP BY track, frame""")
def tension_velocity(spark, d):
    c = B.chroma(spark, d).withColumn("z", H.tonnetz(F.col("chroma"))).withColumn("_n", F.lead("z").over(T.by_track("frame")))
    v = F.coalesce(H.norm(F.zip_with("_n", "z", lambda a, b: a - b)), F.lit(0.0))
    return c.select("track", "frame", r(v).alias("velocity"))


@query(f"""WITH vec AS (SELECT label::BIGINT AS track, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding FROM embeddings), s AS (SELECT track, frame, j, abs(embedding[j + 1])::DOUBLE AS v FROM vec, range(64) AS x(j)),
nx AS (SELECT *, lead(v) OVER (PARTITION BY track, j ORDER BY frame) AS w FROM s) SELECT track, frame, round(sqrt(avg((w - v) * (w - v))), 6) + 0.0 AS flux FROM nx WHERE w IS NOT NULL GROUP BY track, frame""")
def spectral_flux(spark, d):
    v = B.vectors(spark, d).withColumn("_n", F.lead("spec").over(T.by_track("frame"))).where("_n IS NOT NULL")
    f = F.sqrt(H.total(F.zip_with("_n", "spec", lambda a, b: (a - b) * (a - b))) / F.size("spec"))
    return v.select("track", "frame", r(f).alias("flux"))


# ---- overtones --------------------------------------------------------------------------------------------------
def match(spark, d) -> DataFrame:
    """(track, frame, n, magnitude, cents): harmonics 1 to 16 of 150 Hz, each with the nearest of the 30 largest bins within 50 cents."""
    return match_harmonics(B.vectors(spark, d).select("track", "frame", F.lit(150.0).alias("f0"), F.transform("spec", lambda m, j: F.struct(((j + 1) * 40.0).alias("freq"), m.alias("mag"))).alias("peaks")))


HARM = """vec AS (SELECT label::BIGINT AS track, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding FROM embeddings),
pk AS (SELECT track, frame, (j + 1) * 40.0::DOUBLE AS freq, abs(embedding[j + 1])::DOUBLE AS mag FROM vec, range(64) AS x(j) QUALIFY row_number() OVER (PARTITION BY track, frame ORDER BY mag DESC, freq DESC) <= 30),
hm AS (SELECT track, frame, n, mag AS magnitude, abs(1200 * log2(freq / (n * 150.0::DOUBLE))) AS cents FROM pk, range(1, 17) AS y(n) QUALIFY row_number() OVER (PARTITION BY track, frame, n ORDER BY cents, freq) = 1),
hk AS (SELECT * FROM hm WHERE cents <= 50)"""


@query(f"WITH {HARM} SELECT track, frame, n, round(magnitude, 6) + 0.0 AS magnitude, round(cents, 6) + 0.0 AS cents FROM hk")
def harmonic_match(spark, d):
    return match(spark, d).withColumn("magnitude", r("magnitude")).withColumn("cents", r("cents"))


@query(f"WITH {HARM} SELECT h.track, n, round(100.0 * count(*) / (SELECT count(*) FROM vec v WHERE v.track = h.track), 4) + 0.0 AS presence, round(avg(magnitude), 6) + 0.0 AS mean_magnitude FROM hk h GROUP BY h.track, n")
def harmonic_profile(spark, d):
    frames = B.vectors(spark, d).groupBy("track").agg(F.count("*").alias("_f"))
    x = match(spark, d).groupBy("track", "n").agg(F.count("*").alias("c"), F.avg("magnitude").alias("m")).join(frames, "track")
    return x.select("track", "n", r(100.0 * F.col("c") / F.col("_f"), 4).alias("presence"), r("m").alias("mean_magnitude"))


@query(f"WITH {HARM}, dm AS (SELECT * FROM hk WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY track, frame ORDER BY magnitude DESC, n) = 1) SELECT track, n AS dominant, count(*)::BIGINT AS frames FROM dm GROUP BY 1, 2")
def dominant_histogram(spark, d):
    top = Window.partitionBy("track", "frame").orderBy(F.desc("magnitude"), "n")
    x = match(spark, d).where("n > 1").withColumn("_r", F.row_number().over(top)).where("_r = 1")
    return x.groupBy("track", F.col("n").alias("dominant")).agg(F.count("*").alias("frames"))


@query(f"WITH {HARM} SELECT track, frame, n, round(magnitude / max(magnitude) OVER (PARTITION BY track, n), 6) + 0.0 AS heat FROM hk")
def harmonic_heat(spark, d):
    top = F.max("magnitude").over(Window.partitionBy("track", "n"))
    return match(spark, d).select("track", "frame", "n", r(F.col("magnitude") / top).alias("heat"))


@query("SELECT label::BIGINT AS track, frame FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings) WHERE frame % 21 = 0")
def overtone_sampled_frames(spark, d):
    return B.vectors(spark, d).where("frame % 21 = 0").select("track", "frame")


# ---- catalog ----------------------------------------------------------------------------------------------------
@query(f"WITH {CAT} SELECT metric, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max, round(median(value), 4) AS median, count(value)::BIGINT AS n FROM long GROUP BY metric HAVING count(*) >= 2")
def catalog_stats(spark, d):
    return K.stats(K.long_form(B.catalog(spark, d)))


RANK = """rk AS (SELECT track, metric, value, rank() OVER (PARTITION BY metric ORDER BY value)::BIGINT AS rank, count(*) OVER (PARTITION BY metric)::BIGINT AS "of", round(percent_rank() OVER (PARTITION BY metric ORDER BY value) * 100, 1) AS percentile,
  coalesce(round((value - round(avg(value) OVER (PARTITION BY metric), 4)) / nullif(round(stddev_pop(value) OVER (PARTITION BY metric), 4), 0), 2), 0.0) AS z_score FROM long)"""


@query(f"WITH {CAT}, {RANK} SELECT * FROM rk")
def catalog_rank(spark, d):
    return K.rank(K.long_form(B.catalog(spark, d)))


@query(f"WITH {CAT}, a AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value, track) AS lo, row_number() OVER (PARTITION BY metric ORDER BY value DESC, track) AS hi FROM long) SELECT track, metric, value, lo::BIGINT AS place, 'lowest' AS side FROM a WHERE lo <= 3 UNION ALL SELECT track, metric, value, hi::BIGINT, 'highest' FROM a WHERE hi <= 3")
def catalog_extremes(spark, d):
    return K.extremes(K.long_form(B.catalog(spark, d)))


COMPARE = """cp AS (SELECT coalesce(a.metric, b.metric) AS metric, a.value AS a, b.value AS b FROM (SELECT * FROM long WHERE track = 1) a FULL JOIN (SELECT * FROM long WHERE track = 2) b ON a.metric = b.metric)"""


@query(f"WITH {CAT}, {COMPARE} SELECT metric, a, b, round(b - a, 6) + 0.0 AS delta, round(abs(b - a) / greatest(abs(a), abs(b), 0.001), 6) + 0.0 AS divergence, CASE WHEN abs(b - a) / greatest(abs(a), abs(b), 0.001) > 0.5 THEN '##' WHEN abs(b - a) / greatest(abs(a), abs(b), 0.001) > 0.2 THEN '++' WHEN abs(b - a) / greatest(abs(a), abs(b), 0.001) > 0.1 THEN '..' ELSE '' END AS marker FROM cp WHERE a IS NOT NULL AND b IS NOT NULL")
def compare_tracks(spark, d):
    x = K.compare(K.long_form(B.catalog(spark, d)), 1, 2).where("found = 'both'")
    return x.select("metric", "a", "b", r("delta").alias("delta"), r("divergence").alias("divergence"), S.divergence_marker(F.col("divergence")).alias("marker"))


@query(f"WITH {CAT}, l2 AS (SELECT * FROM long WHERE NOT (track = 1 AND metric = 'lines') AND NOT (track = 2 AND metric = 'mean_price')) SELECT coalesce(a.metric, b.metric) AS metric, CASE WHEN a.value IS NULL THEN 'only_b' ELSE 'only_a' END AS found FROM (SELECT * FROM l2 WHERE track = 1) a FULL JOIN (SELECT * FROM l2 WHERE track = 2) b ON a.metric = b.metric WHERE a.value IS NULL OR b.value IS NULL")
def only_in(spark, d):
    x = K.long_form(B.catalog(spark, d)).where("NOT (track = 1 AND metric = 'lines') AND NOT (track = 2 AND metric = 'mean_price')")
    return K.compare(x, 1, 2).where("found <> 'both'").select("metric", "found")


# ---- text -------------------------------------------------------------------------------------------------------
@query("""SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url || ' (Official) ft. X'), '\\([^)]*\\)', '', 'g'), '\\[[^\\]]*\\]', '', 'g'), '[–—/|]+', ' ', 'g'), '\\bft\\..*$|\\bfeat\\..*$', '', 'g'), '[^a-z0-9\\s-]', '', 'g')), '\\s+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS slug FROM pages""")
def slugify(spark, d):
    return table(spark, d, "pages").select("page_id", S.slugify(F.concat("url", F.lit(" (Official) ft. X"))).alias("slug"))


@query("SELECT page_id, regexp_matches(url, '^[A-Za-z0-9._-]+$') AND url NOT IN ('.', '..') AS url_ok, regexp_matches(page_id::VARCHAR, '^[A-Za-z0-9._-]+$') AS id_ok, regexp_matches('https://youtu.be/abcdefghij' || (page_id % 10)::VARCHAR, '^https?://(www\\.)?(youtube\\.com/watch\\?.*v=|youtu\\.be/)[A-Za-z0-9_\\-]{11}') AS video_ok FROM pages")
def validate_slug(spark, d):
    return table(spark, d, "pages").select("page_id", S.valid_slug(F.col("url")).alias("url_ok"), S.valid_slug(F.col("page_id").cast("string")).alias("id_ok"), S.valid_video_url(F.concat(F.lit("https://youtu.be/abcdefghij"), (F.col("page_id") % 10).cast("string"))).alias("video_ok"))


@query("SELECT event_id, event_id * 1.25::DOUBLE % 4000 AS seconds FROM events")
def parse_timestamp(spark, d):
    s = F.col("event_id") * F.lit(1.25) % 4000
    whole = F.floor(s).cast("long")
    text = F.concat(F.floor(whole / 3600).cast("string"), F.lit(":"), F.floor(whole % 3600 / 60).cast("string"), F.lit(":"), (whole % 60).cast("string"), F.lit(","), F.lpad(F.round((s - whole) * 100).cast("int").cast("string"), 2, "0"))
    return table(spark, d, "events").select("event_id", S.parse_timestamp(text).alias("seconds"))


@query("SELECT event_id, (value::BIGINT // 60)::VARCHAR || ':' || lpad((floor(value)::BIGINT % 60)::VARCHAR, 2, '0') AS shown FROM (SELECT event_id, floor(value) AS value FROM events)")
def fmt_time(spark, d):
    return table(spark, d, "events").select("event_id", S.format_time(F.col("value")).alias("shown"))


TURNS = "tr AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations)"
WORDS = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1))"


@query(f"WITH {TURNS}, w AS (SELECT conv_id, turn, {WORDS.format('text')} AS a, {WORDS.format('nxt')} AS b FROM tr WHERE nxt IS NOT NULL) SELECT conv_id, turn, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0.0 END, 6) + 0.0 AS overlap FROM w")
def jaccard_overlap(spark, d):
    x = table(spark, d, "conversations").withColumn("_n", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("_n IS NOT NULL")
    return x.select("conv_id", "turn", r(S.word_overlap(S.align_words(F.col("text")), S.align_words(F.col("_n")))).alias("overlap"))


@query("SELECT conv_id, turn, regexp_replace(regexp_replace('Shit, ' || text || ' bitches', '\\bshit\\b', 's***', 'gi'), '\\bbitch(es)?\\b', 'b****', 'gi') AS clean FROM conversations")
def censor(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", S.censor(F.concat(F.lit("Shit, "), "text", F.lit(" bitches"))).alias("clean"))


@query(f"""WITH {HOURS}, {GRID}, {MOMENTUM}, m AS (SELECT track, t AS time, round(1 - momentum, 6) AS x FROM stream)
SELECT track, time, 'pattern_break' AS type, x AS intensity FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY track ORDER BY x DESC, time) <= 5) WHERE x > 0.2""")
def pattern_breaks(spark, d):
    b = B.hours(spark, d)
    x = T.momentum(b, points(b)).select("track", "t", F.round(1 - F.col("momentum"), 6).alias("disruption"))
    return E.pattern_breaks(x)


@query(f"WITH {HOURS}, {FRAMES}, {SILENCE}, {GRID} SELECT g.track, g.i, s.depth_db AS depth FROM grid g JOIN sil s ON s.track = g.track AND s.\"start\" <= g.t AND g.t <= s.\"end\"")
def silence_flags(spark, d):
    b = B.hours(spark, d)
    return T.in_silence(points(b), _silences(spark, d)).where("silence").select("track", "i", F.col("silence_depth_db").alias("depth"))


@query(f"WITH {HOURS} SELECT track, type, n FROM (SELECT event_type AS track, CASE WHEN value > 100 THEN 'loud' ELSE 'soft' END AS type, count(*)::BIGINT AS n FROM events GROUP BY ROLLUP (1, 2))")
def event_rollup(spark, d):
    x = B.hours(spark, d).withColumn("type", F.when(F.col("value") > 100, "loud").otherwise("soft"))
    return x.rollup("track", "type").agg(F.count("*").alias("n"))
