"""Queries over catalogs, events' layouts, frame plans and signals, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import catalog as K
from ..operators import events as E
from ..operators import timeseries as T
from ..session import table
from ..sources import analysis as A
from ..sources import wav as W
from . import bindings as B
from . import modules as M
from .analysis_queries import LISTEN, PERCEPTION, UNION, _perception
from .queries import CAT, RANK, query, r

CARD = {"mean_quantity": ("Quantity", "mean"), "mean_price": ("Price", "mean"), "max_quantity": ("Top", "largest"), "lines": ("Lines", "count")}
_rows = ", ".join(f"({i}, '{k}', '{a}', '{b}')" for i, (k, (a, b)) in enumerate(CARD.items()))


@query(f"""WITH {CAT}, {RANK}, cd AS (SELECT * FROM (VALUES {_rows}) AS v(p, metric, label, about))
SELECT track, '=== ' || track::VARCHAR || ' -- Catalog Position ===' || chr(10) || chr(10) || string_agg('  ' || label || ': ' || format('{{:.3f}}', round(value, 3)) || ' (rank ' || rank::VARCHAR || '/' || "of"::VARCHAR || ', z=' || CASE WHEN z_score < 0 THEN '-' ELSE '+' END || format('{{:.1f}}', abs(round(z_score, 1))) || ') -- ' || about, chr(10) ORDER BY p) AS card FROM rk JOIN cd USING (metric) GROUP BY track""")
def summary_card(spark, d):
    return K.summary_cards(K.long_form(B.catalog(spark, d)), CARD)


@query("""WITH p AS (SELECT l_suppkey AS track, avg(l_quantity) AS m, max(l_quantity) AS a, avg(l_discount) * 200 AS q FROM lineitem GROUP BY 1), h AS (SELECT s_suppkey AS track, s_acctbal AS mean_tension, s_name AS detected_key FROM supplier WHERE s_acctbal > 0)
SELECT coalesce(p.track, h.track) AS track, round(CASE WHEN q >= 10 THEN a ELSE m END, 6) + 0.0 AS mean_momentum, round(q, 6) + 0.0 AS silence_pct, mean_tension, detected_key FROM p FULL JOIN h ON p.track = h.track""")
def catalog_index(spark, d):
    p = B.in_order(spark, d, "lineitem", F.col("l_suppkey"), "l_quantity", "l_discount").groupBy("track").agg(F.avg("l_quantity").alias("mean_momentum"), F.max("l_quantity").alias("mean_momentum_active"), (F.avg("l_discount") * 200).alias("silence_pct"))
    h = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("track"), F.col("s_acctbal").alias("mean_tension"), F.col("s_name").alias("detected_key"))
    return K.index_metrics(p, [h]).select("track", r("mean_momentum").alias("mean_momentum"), r("silence_pct").alias("silence_pct"), "mean_tension", "detected_key")


@query("""WITH p AS (SELECT l_suppkey AS track, round(avg(l_quantity), 4) AS m, max(l_quantity) AS a, round(avg(l_discount) * 200, 4) AS q FROM lineitem GROUP BY 1), h AS (SELECT s_suppkey AS track, round(s_acctbal, 2) AS t, s_name AS k FROM supplier)
SELECT track, CASE WHEN q >= 10 THEN a ELSE m END AS mean_momentum, CASE WHEN q >= 10 THEN a / 2 ELSE CASE WHEN track % 2 = 0 THEN m / 2 ELSE m / 4 END END AS mean_pattern_lock, q AS silence_pct, t AS mean_tension, k AS detected_key FROM p JOIN h USING (track)""")
def catalog_rebuild(spark, d):
    """Documents of two modules for each supplier; every other track has the older name of the pattern lock."""
    m, half = F.round(F.avg("l_quantity"), 4), F.lit(2.0)
    p = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("track")).agg(m.alias("mean_momentum"), F.max("l_quantity").alias("mean_momentum_active"), F.round(F.avg("l_discount") * 200, 4).alias("silence_pct"))
    lock = F.when(F.col("track") % 2 == 0, F.col("mean_momentum") / half)
    doc = F.to_json(F.struct(F.struct("mean_momentum", "mean_momentum_active", "silence_pct", lock.alias("mean_pattern_lock"), (F.col("mean_momentum_active") / half).alias("mean_pattern_lock_active"), (F.col("mean_momentum") / 4).alias("mean_surprise")).alias("summary")))
    h = table(spark, d, "supplier").select(F.col("s_suppkey").alias("track"), F.to_json(F.struct(F.round("s_acctbal", 2).alias("mean_tension"), F.col("s_name").alias("detected_key"))).alias("_h"))
    docs = p.select("track", doc.alias("_p")).join(h, "track").select("track", F.try_parse_json("_p").alias("perception"), F.try_parse_json("_h").alias("harmony"))
    return K.rebuild(docs, A.metric, A.text_field).select("track", "mean_momentum", "mean_pattern_lock", "silence_pct", "mean_tension", "detected_key")


@query("""SELECT s_suppkey AS track, CASE WHEN s_acctbal > 5000 THEN s_acctbal * 2 ELSE s_acctbal END AS m, CASE WHEN s_acctbal > 5000 THEN s_name END AS note FROM supplier""")
def catalog_upsert(spark, d):
    old = table(spark, d, "supplier").select(F.col("s_suppkey").alias("track"), F.col("s_acctbal").alias("m"))
    new = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("track"), (F.col("s_acctbal") * 2).alias("m"), F.col("s_name").alias("note"))
    return K.upsert(old, new)


@query(f"""WITH {CAT} SELECT 'report' AS module, track, 'tempo_bpm' AS metric, mean_quantity AS value FROM cat UNION ALL SELECT 'melody', track, 'mean_direction', mean_discount FROM cat""")
def flatten_metrics(spark, d):
    """Only the listed metrics of each module are compared."""
    c = B.catalog(spark, d)
    report = c.select("track", F.col("mean_quantity").alias("tempo_bpm"), F.col("mean_price").alias("not_listed"), F.lit("x").alias("rhythm"))
    melody = c.select("track", F.col("mean_discount").alias("mean_direction"))
    x = K.flatten({"report": report, "melody": melody})
    module = reduce(lambda a, m: a.when(F.col("metric").isin(K.COMPARED[m]), m), K.COMPARED, F.when(F.lit(False), ""))
    return x.select(module.alias("module"), "track", "metric", "value")


# ---- events -----------------------------------------------------------------------------------------------------
@query("""WITH e AS (SELECT user_id AS track, (epoch_us(ts) - 1704067200000000) / 1e6 AS time, value, user_id % 2 = 0 AS fresh FROM events)
SELECT track, time, CASE WHEN fresh OR value > 100 THEN 'pattern_break' ELSE 'silence' END AS type, value AS intensity, row_number() OVER (PARTITION BY track ORDER BY time)::BIGINT - 1 AS place FROM e""")
def old_and_new_events(spark, d):
    """Every other user has the older layout: loud events as moments, the others as silences."""
    t = (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)") / 1e6).alias("time")
    null = F.lit(None).cast("double")
    row = lambda kind: F.struct(t, F.lit(kind).alias("type"), F.col("value").alias("intensity"), null.alias("duration"), null.alias("depth_db"), null.alias("from"), null.alias("to"))
    loud = F.col("value") > 100
    gather = lambda c: F.sort_array(F.collect_list(c))
    x = table(spark, d, "events").groupBy(F.col("user_id").alias("track")).agg(
        gather(F.when(F.col("user_id") % 2 == 0, row("pattern_break"))).alias("pattern_breaks"), gather(F.when((F.col("user_id") % 2 == 1) & loud, row("pattern_break"))).alias("moments"), gather(F.when((F.col("user_id") % 2 == 1) & ~loud, row("silence"))).alias("silences"),
    )
    return E.load_events(x).select("track", F.posexplode("events").alias("place", "e")).select("track", "e.time", "e.type", "e.intensity", F.col("place").cast("long").alias("place"))


@query(f"""WITH {UNION} SELECT track, time, type, CASE WHEN type = 'silence' THEN format('{{:.1f}}', round(duration, 1)) || 's silence at ' || format('{{:.0f}}', round(depth_db, 0)) || 'dB'
  WHEN type = 'pattern_break' THEN 'pattern break (intensity ' || format('{{:.3f}}', intensity) || ')' ELSE replace(type, '_', ' ') || ' (' || format('{{:.3f}}', "from") || ' → ' || format('{{:.3f}}', "to") || ')' END AS label FROM un""")
def event_labels(spark, d):
    text = E.event_label(*[F.col(f"`{c}`") for c in ("type", "intensity", "duration", "depth_db", "from", "to")])
    return _perception(spark, d)[1].select("track", "time", "type", text.alias("label"))


TIMES = """list_concat([{'time': b, 'role': 'before'}], CASE WHEN b <> time THEN [{'time': time, 'role': 'onset'}] ELSE [] END, CASE WHEN type = 'silence' AND coalesce(duration, 0.0) >= 3 AND m <> b AND m <> time THEN [{'time': m, 'role': 'during'}] ELSE [] END)"""
CLAMPED = "greatest(0.0, least(dur.duration, un.time - 1)) AS b, greatest(0.0, least(dur.duration, un.time + 0.6 * un.duration)) AS m"


@query(f"""WITH {UNION} SELECT track, time AS event_time, type, x.time AS time, x.role AS role FROM (SELECT track, time, type, unnest({TIMES}) AS x FROM (SELECT un.track, un.time, un.type, un.duration, {CLAMPED} FROM un JOIN dur ON dur.track = un.track))""")
def event_timestamps(spark, d):
    x = M.heard(B.listeners_once(spark, d, [*M.HEARS, "untimed"]), B.FRAME).select("track", F.col("duration").alias("_total"), F.explode("events").alias("e"))
    times = E.event_times(F.col("e.time"), F.col("e.type"), F.col("e.duration"), F.col("_total"))
    return x.select("track", F.col("e.time").alias("event_time"), "e.type", F.explode(times).alias("x")).select("track", "event_time", "type", "x.time", "x.role")


# ---- frame plans ------------------------------------------------------------------------------------------------
def gaps(edges: str, need: str, out: str) -> str:
    """SQL of the middles of the widest gaps between ``edges`` (track, time), n for each track of ``need`` (track, duration, n)."""
    return f"""{out}m AS (SELECT DISTINCT track, time FROM (SELECT track, time FROM {edges} UNION ALL SELECT track, unnest([0.0, duration]) FROM {need})),
{out}g AS (SELECT track, time AS lo, lead(time) OVER (PARTITION BY track ORDER BY time) AS hi FROM {out}m),
{out}p AS (SELECT g.track, x.n, lo, (hi - lo) / pow(2.0, k) AS w, k FROM {out}g g JOIN {need} x ON x.track = g.track, range(0, 12) AS l(k) WHERE hi IS NOT NULL AND x.n > 0 AND x.duration > 0 AND k < ceil(log2(x.n + 1.0))),
{out}q AS (SELECT track, n, lo + j * w AS lo, w FROM (SELECT *, unnest(range(0, pow(2, k)::BIGINT)) AS j FROM {out}p)),
{out} AS (SELECT track, lo + w / 2 AS time FROM {out}q QUALIFY row_number() OVER (PARTITION BY track ORDER BY w DESC, lo) <= n)"""


NONE = "'coverage' AS kind, 'coverage' AS role, NULL::VARCHAR AS event_type, NULL::DOUBLE AS event_time, NULL::VARCHAR AS grp"
PLAN = f"""{UNION}, cl AS (SELECT *, sum(new) OVER (PARTITION BY track ORDER BY time) AS c FROM (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY track ORDER BY time) <= 2 THEN 0 ELSE 1 END AS new FROM un)),
bs AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY track, c ORDER BY (type = 'silence') DESC, CASE WHEN type = 'silence' THEN duration ELSE intensity END DESC, time) = 1),
sk AS (SELECT bs.*, row_number() OVER (PARTITION BY track ORDER BY CASE WHEN type = 'silence' THEN 2.0 * (0.4 * least(1.0, abs(coalesce(depth_db, -80.0)) / 80) + 0.6 * least(1.0, coalesce(duration, 0.0) / 10)) WHEN type LIKE 'momentum%' THEN 0.8 * least(1.0, abs("to" - "from")) ELSE intensity END DESC, time) AS rk FROM bs),
sl AS (SELECT track, rk, unnest({TIMES}) AS x, generate_subscripts({TIMES}, 1) AS pos, type, time FROM (SELECT un.track, un.rk, un.type, un.time, un.duration, {CLAMPED} FROM (SELECT * FROM sk WHERE rk <= 7) un JOIN dur ON dur.track = un.track)),
sn AS (SELECT track, x.time AS time, 'anchor' AS kind, x.role AS role, type AS event_type, time AS event_time, type || '_' || format('{{:.1f}}', round(time, 1)) AS grp, row_number() OVER (PARTITION BY track ORDER BY rk, pos) AS n FROM sl QUALIFY row_number() OVER (PARTITION BY track ORDER BY rk, pos) <= 7),
n1 AS (SELECT dur.track, duration, 12 - coalesce(c, 0) AS n FROM dur LEFT JOIN (SELECT track, count(*) AS c FROM sn GROUP BY track) USING (track)), {gaps('sn', 'n1', 'c1')},
fs AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY time, n) AS k FROM (SELECT * FROM sn UNION ALL SELECT track, time, {NONE}, 12 FROM c1)),
rl AS (SELECT *, list_position(['before', 'onset', 'during', 'coverage'], role) AS pr FROM fs),
fo AS (SELECT track, k, 1 AS slot, k AS held, time AS at, pr AS best FROM rl WHERE k = 1
  UNION ALL SELECT f.track, s.k, CASE WHEN s.time - f.at >= 1 THEN f.slot + 1 ELSE f.slot END, CASE WHEN s.time - f.at >= 1 OR s.pr < f.best THEN s.k ELSE f.held END, CASE WHEN s.time - f.at >= 1 OR s.pr < f.best THEN s.time ELSE f.at END, CASE WHEN s.time - f.at >= 1 OR s.pr < f.best THEN s.pr ELSE f.best END FROM fo f JOIN rl s ON s.track = f.track AND s.k = f.k + 1),
kp AS (SELECT rl.* FROM rl JOIN (SELECT track, slot, max(held) AS held FROM fo GROUP BY track, slot) h ON h.track = rl.track AND h.held = rl.k),
n2 AS (SELECT dur.track, duration, 12 - coalesce(c, 0) AS n FROM dur LEFT JOIN (SELECT track, count(*) AS c FROM kp GROUP BY track) USING (track)), {gaps('kp', 'n2', 'c2')},
pl AS (SELECT track, time, kind, role, event_type, event_time, grp FROM kp UNION ALL SELECT track, time, {NONE} FROM c2)"""


def _plan(spark, d) -> DataFrame:
    f = B.listeners(spark, d)
    return M.visual_plan(M.perception(f, B.FRAME)[1], f.select("track", F.col("duration").alias("duration_seconds")), None, 12, 0.6)


@query(f'WITH RECURSIVE {PLAN} SELECT track, time, kind, role, event_type, event_time, grp AS "group" FROM pl')
def frame_plan(spark, d):
    return _plan(spark, d)


@query(f"""WITH RECURSIVE {PLAN}, dg AS (SELECT track, grp, min(time) AS time, string_agg(format('{{:.6f}}', round(time, 6)) || ' ' || role, ', ' ORDER BY time, role) AS frames, any_value(event_type) AS event_type FROM pl WHERE kind = 'anchor' GROUP BY track, grp
  UNION ALL SELECT track, NULL, time, format('{{:.6f}}', round(time, 6)) || ' ' || role, NULL FROM pl WHERE kind = 'coverage')
SELECT track, grp AS "group", round(time, 6) + 0.0 AS time, frames, event_type, row_number() OVER (PARTITION BY track ORDER BY dg.time, grp IS NULL, grp)::BIGINT AS place FROM dg""")
def frame_groups(spark, d):
    x = E.description_groups(_plan(spark, d))
    shown = F.array_join(F.transform("frames", lambda f: F.concat(F.format_string("%.6f ", F.round(f.time, 6)), f.role)), ", ")
    return x.drop("event_time").withColumn("frames", shown).withColumn("time", r("time"))


@query(f"WITH RECURSIVE {PLAN} SELECT pl.track, least(2, floor(time / (duration / 3)))::BIGINT AS third, count(*)::BIGINT AS n FROM pl JOIN dur ON dur.track = pl.track GROUP BY 1, 2")
def third_coverage(spark, d):
    return E.thirds(_plan(spark, d).join(B.listeners(spark, d).select("track", "duration"), "track"))


@query(f"WITH {LISTEN}, on_ AS (SELECT track, t AS time FROM ev WHERE value > 450), nd AS (SELECT track, duration, 9 AS n FROM dur), {gaps('on_', 'nd', 'gp')} SELECT track, time FROM gp")
def gap_fill(spark, d):
    f = B.listeners(spark, d)
    loud = table(spark, d, "events").where("value > 450").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("track"), (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)") / 2.16e10).alias("time"))
    x = f.select("track", "duration").join(loud.groupBy("track").agg(F.collect_list("time").alias("at")), "track", "left")
    return x.select("track", F.explode(E.bisect_gaps(F.coalesce("at", F.array().cast("array<double>")), F.col("duration"), F.lit(9))).alias("time"))


# ---- signals ----------------------------------------------------------------------------------------------------
@query("""WITH s AS (SELECT user_id AS track, sqrt(avg(CASE WHEN user_id % 5 = 0 THEN 0.0 ELSE pow((value / 1000)::FLOAT::DOUBLE, 2) END)) AS rms, count(*) / 10.0 AS duration FROM events GROUP BY 1)
SELECT track, CASE WHEN track % 7 = 6 THEN 'unreadable' WHEN rms < 1e-6 THEN 'no signal' END AS reason, CASE WHEN track % 7 = 6 OR rms < 1e-6 THEN round(rms, 6) + 0.0 END AS rms, duration FROM s""")
def null_guard(spark, d):
    """A signal per user, silent for every fifth and unreadable for every seventh: what is analysed and what is rejected."""
    y = F.when(F.col("user_id") % 5 == 0, 0.0).otherwise(F.col("value") / 1000).cast("float")
    x = table(spark, d, "events").groupBy(F.col("user_id").alias("track")).agg(F.collect_list(y).alias("y")).withColumns({"sr": F.lit(10), "error": F.when(F.col("track") % 7 == 6, "unreadable")})
    good, rejects = W.split_null(x)
    kept = good.select("track", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("double").alias("rms"), "duration")
    return kept.unionByName(rejects.select("track", "reason", r("rms").alias("rms"), "duration"))


@query("SELECT p_partkey, 12 * log2(p_retailprice / 440.0) + 69 > 0 AS high, round(12 * log2(p_retailprice / 440.0) + 69, 6) AS midi FROM part")
def hz_to_midi(spark, d):
    m = S.hz_to_midi(F.col("p_retailprice"))
    return table(spark, d, "part").select("p_partkey", (m > 0).alias("high"), F.round(m, 6).alias("midi"))


@query(f"WITH {PERCEPTION} SELECT track, round(avg((quiet)::INT), 6) + 0.0 AS quiet_share, round(min(depth_db), 1) AS deepest FROM al GROUP BY track")
def quiet_share(spark, d):
    x = _perception(spark, d)[0]
    return x.groupBy("track").agg(r(F.avg(F.col("silence").cast("int"))).alias("quiet_share"), F.min("silence_depth_db").alias("deepest"))


@query(f"WITH {LISTEN}, x AS (SELECT track, t AS time, t - lag(t) OVER (PARTITION BY track ORDER BY t) AS gap FROM ev) SELECT track, time, sum(CASE WHEN gap <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY track ORDER BY time)::BIGINT AS cluster FROM x")
def beat_clusters(spark, d):
    beats = B.listeners(spark, d).select("track", F.explode("beats").alias("t"))
    return T.clusters(beats, 2.0).select("track", F.col("t").alias("time"), "cluster")


@query("""WITH v AS (SELECT label::BIGINT AS track, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 64 AS base, embedding FROM embeddings), y AS (SELECT track, base + j AS i, embedding[j + 1]::DOUBLE AS x FROM v, range(64) AS u(j)),
tn AS (SELECT *, CASE WHEN i > 0 AND (x < 0) <> (lag(x) OVER (PARTITION BY track ORDER BY i) < 0) THEN 1 ELSE 0 END AS turn FROM y),
fr AS (SELECT track, i - (k * 64 - 32) AS n, k AS frame, x, turn FROM tn, (VALUES (0), (1)) AS w(d), LATERAL (SELECT i // 64 + d AS k) WHERE i >= k * 64 - 32 AND i < k * 64 + 32),
sp AS (SELECT track, frame, b, sqrt(pow(sum(x * h * cos(2 * pi() * b * n / 64)), 2) + pow(sum(x * h * sin(2 * pi() * b * n / 64)), 2)) AS m FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * n / 64) AS h FROM fr), range(33) AS q(b) GROUP BY 1, 2, 3),
ce AS (SELECT track, frame, sum(m * b) / sum(m) AS centroid FROM sp GROUP BY 1, 2), ag AS (SELECT track, frame, sqrt(sum(x * x) / 64) AS rms, sum(turn) / 64 AS zcr FROM fr GROUP BY 1, 2)
SELECT track, frame, round(rms, 6) + 0.0 AS rms, round(zcr, 6) + 0.0 AS zcr, round(centroid, 1) + 0.0 AS centroid FROM ag JOIN ce USING (track, frame)""")
def kernel_frames(spark, d):
    """A label's vectors end to end as a signal: energy, zero crossings and spectral centroid of centred frames of 64 samples."""
    y = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("frame", "e"))), lambda s: s.e))
    x = B.vectors(spark, d, F.col("embedding").alias("e")).groupBy("track").agg(y.alias("y"))

    def run(batches):
        import numpy as np
        import pandas as pd

        from ..operators import signal as G

        for pdf in batches:
            for track, samples in zip(pdf["track"], pdf["y"], strict=True):
                s = np.asarray(samples, dtype=np.float64)
                rms = G.rms(s, 64, 64)
                yield pd.DataFrame({"track": track, "frame": range(len(rms)), "rms": rms, "zcr": G.zero_crossings(s, 64, 64), "centroid": G.centroid(G.stft(s, 64, 64), G.frequencies(64, 64))})

    out = x.mapInPandas(run, "track long, frame long, rms double, zcr double, centroid double")
    return out.select("track", "frame", r("rms").alias("rms"), r("zcr").alias("zcr"), r("centroid", 1).alias("centroid"))


@query("""SELECT doc_id, round(CASE WHEN p + h = 0 THEN NULL ELSE (p - h) / (p + h) END, 6) + 0.0 AS balance FROM (SELECT doc_id, n_chars::DOUBLE AS h, length(coalesce(text, '')) / 2.0 AS p FROM documents)""")
def track_balance(spark, d):
    from ..cli import hp_balance

    x = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("h"), (F.char_length(F.coalesce("text", F.lit(""))) / 2.0).alias("p"))
    return x.select("doc_id", r(hp_balance(F.col("h"), F.col("p"))).alias("balance"))
