import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import captions as C
from tidemark.operators import catalog as K
from tidemark.operators import events as E
from tidemark.plans import prompt as P
from tidemark.sources import analysis as A

EV = "track string, t double, type string, intensity double, duration double, depth_db double, `from` double, `to` double, cluster long"


@pytest.mark.parametrize("target, n, duration", [(12, 0, 300.0), (12, 5, 300.0), (8, 0, 120.0), (20, 10, 600.0), (5, 0, 60.0), (1, 0, 30.0)])
def test_plan_has_exactly_the_target(spark, target, n, duration):
    ev = spark.createDataFrame([("a", i * 10.0, "break", 0.5, None, None, None, None, i) for i in range(n)], EV)
    d = spark.createDataFrame([("a", duration)], "track string, duration double")
    plan = E.select_frames(ev, d, target).collect()
    assert len(plan) == target and [p.time for p in plan] == sorted(p.time for p in plan)


@pytest.mark.parametrize("target, ratio", [(0, 0.5), (-1, 0.5), (5, -0.1), (5, 1.5)])
def test_plan_arguments(spark, target, ratio):
    d = spark.createDataFrame([("a", 10.0)], "track string, duration double")
    with pytest.raises(ValueError):
        E.select_frames(spark.createDataFrame([], EV), d, target, ratio)


def test_event_times(spark):
    x = spark.createDataFrame([(0.5, "break", None), (10.0, "silence", 5.0), (0.0, "break", None)], "t double, type string, d double")
    got = [[(p.time, p.role) for p in r[0]] for r in x.select(E.event_times(F.col("t"), F.col("type"), F.col("d"), F.lit(100.0))).collect()]
    assert got == [[(0.0, "before"), (0.5, "onset")], [(9.0, "before"), (10.0, "onset"), (13.0, "during")], [(0.0, "before")]]


def halved(times, duration, n):
    """One gap after the other: the widest, the earliest of equals."""
    edges, out = sorted({0.0, duration, *times}), []
    for _ in range(n):
        at = max(range(len(edges) - 1), key=lambda i: (edges[i + 1] - edges[i], -i))
        out.append((edges[at] + edges[at + 1]) / 2)
        edges = sorted([*edges, out[-1]])
    return out


def test_bisection_takes_the_widest_gap(spark):
    rng = random.Random(4)
    cases = [([], 8.0, 3), ([1.0], 10.0, 1), ([2.0, 4.0], 8.0, 9), ([0.0, 8.0], 8.0, 4)] + [([rng.randint(0, 64) / 4 for _ in range(rng.randint(0, 6))], 16.0, rng.randint(1, 20)) for _ in range(20)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, times array<double>, duration double, n int")
    got = df.orderBy("i").select(E.bisect_gaps(F.col("times"), F.col("duration"), F.col("n"))).collect()
    assert [r[0] for r in got] == [halved(*c) for c in cases]
    none = spark.createDataFrame([([], 0.0, 3), ([1.0], 5.0, 0), ([1.0], 5.0, -2)], df.drop("i").schema)
    assert [r[0] for r in none.select(E.bisect_gaps(F.col("times"), F.col("duration"), F.col("n"))).collect()] == [[], [], []]


def test_plan_keeps_the_better_of_two_close_slots(spark):
    slot = "array<struct<time:double,kind:string,role:string,event_type:string,event_time:double,group:string>>"
    rows = [(0.0, "before"), (0.5, "coverage"), (1.2, "coverage"), (1.9, "onset"), (2.5, "before"), (3.6, "during")]
    df = spark.createDataFrame([([(t, "k", r, None, None, None) for t, r in rows],)], f"a {slot}")
    got = df.select(E.spaced(F.col("a"), 1.0).alias("a")).first().a
    # the onset takes the place of the coverage before it, and the slot before the next event that of the onset
    assert [(s.time, s.role) for s in got] == [(0.0, "before"), (2.5, "before"), (3.6, "during")]


def test_old_and_new_events(spark):
    schema = "track string, pattern_breaks array<struct<time:double,type:string,intensity:double,duration:double,depth_db:double,from:double,to:double>>"
    schema += ", moments array<struct<time:double,type:string,intensity:double,duration:double,depth_db:double,from:double,to:double>>"
    e = lambda t: (t, "break", 0.5, None, None, 0.1, 0.9)
    x = spark.createDataFrame([("new", [e(1.0)], [e(2.0)]), ("old", [], [e(3.0), e(2.0)])], schema)
    got = {r.track: [(v.time, v["from"]) for v in r.events] for r in E.load_events(x).collect()}
    assert got == {"new": [(1.0, 0.1)], "old": [(2.0, 0.1), (3.0, 0.1)]}


def test_rolling_captions():
    assert C.rolling_text(["a b c", "b c d", "", "x"]) == "a b c d x"
    assert C.rolling_lines([(0.0, "a b c d e"), (1.0, "d e f g h i"), (2.0, "z")]) == [(0.0, "a b c d e f g h i"), (2.0, "z")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_overlap_is_the_longest(done, new):
    assert C.overlap(done, new) == max(k for k in range(min(len(done), len(new)) + 1) if done[len(done) - k :] == new[:k])


def test_alignment_moves_forward():
    segs = [(0.0, "hello world"), (4.0, "other words here"), (8.0, "hello world")]
    got = C.align(["hello world", "other words", "hello world", "zz qq"], segs)
    assert [g[1] for g in got] == [0.0, 4.0, 8.0, None] and got[0][2] == 1.0
    assert C.align(["x", "hello"], []) == [("x", None, 0.0), ("hello", None, 0.0)]


def test_alignment_window_and_misses():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    segs = [(float(i), " ".join(rng.sample(words, rng.randint(0, 6)))) for i in range(60)]
    lines = [" ".join(rng.sample(words, rng.randint(0, 5))) for _ in range(50)]
    at = 0
    for line, (text, start, score) in zip(lines, C.align(lines, segs, 5, 0.3)):
        bag = set(line.split())
        scores = [len(bag & set(t.split())) / len(bag | set(t.split())) if bag and t else 0.0 for _, t in segs[at : at + 5]]
        assert text == line
        if bag and max(scores) >= 0.3:
            at += scores.index(max(scores))
            assert (start, score) == (segs[at][0], round(max(scores), 3))
        else:
            assert (start, score) == (None, 0.0)
            at = min(at + 1, len(segs) - 1) if bag else at


def test_cues_and_pages():
    vtt = "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\n<c>one</c> two\n\n00:03.500 --> x\none two\n\n00:05.000 --> x\nthree\n"
    assert C.parse_cues(vtt) == [(1.0, "one two"), (5.0, "three")]
    box = '<div data-lyrics-container="true"><br>[Verse]<br/>line &amp; one<br>two</div>'
    lines, sections = C.parse_lyric_page(box + box + "You might also like")
    assert sections == ["Verse"] and [x for x in lines if "one" in x or x == "two"] == ["line & one", "two"]
    assert C.parse_lyric_page("<p>none</p>") == ([], [])


def test_catalog(spark):
    wide = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, None), ("c", 3.0, None)], "track string, m double, k double")
    v = K.long_form(wide)
    assert [(r.metric, r.n, r["mean"]) for r in K.stats(v).collect()] == [("m", 3, 2.3333)]
    ranks = {r.track: (r["rank"], r.percentile) for r in K.rank(v).where("metric = 'm'").collect()}
    assert ranks == {"a": (1, 0.0), "b": (2, 50.0), "c": (2, 50.0)}
    c = {r.metric: r.found for r in K.compare(v, "a", "b").collect()}
    assert c == {"m": "both", "k": "only_a"}


def test_rank_in_ranges_is_the_plain_rank(spark, monkeypatch):
    monkeypatch.setattr(K, "BUCKETS", 4)
    rng = random.Random(3)
    rows = [(f"t{i}", m, float(rng.randint(0, 9)) if m == "few" else rng.gauss(0, 3)) for m in ("few", "many") for i in range(60)] + [("t1", "alone", 2.0)] + [(f"t{i}", "same", 5.0) for i in range(9)]
    got = {(r.track, r.metric): r for r in K.rank(spark.createDataFrame(rows, "track string, metric string, value double")).collect()}
    assert len(got) == len(rows) - 1
    for t, m, v in rows:
        own = [x for _, n, x in rows if n == m]
        if len(own) > 1:
            r = got[t, m]
            assert r["rank"] == 1 + sum(x < v for x in own) and r.of == len(own) and r.percentile == pytest.approx(100 * (r["rank"] - 1) / (len(own) - 1), abs=0.06)
    assert got["t0", "same"].z_score == 0


def test_legacy_zero_survives(spark):
    x = spark.createDataFrame([("a", 0.0, 99.9)], "track string, mean_pattern_lock double, mean_surprise double")
    assert K.legacy_names(x).first().mean_pattern_lock == 0.0


def test_active_metrics_from_the_threshold(spark):
    p = spark.createDataFrame([("a", 0.4, 0.8, 5.0), ("b", 0.4, 0.8, 15.0), ("c", 0.4, 0.8, 10.0)], "track string, mean_momentum double, mean_momentum_active double, silence_pct double")
    assert {r.track: r.mean_momentum for r in K.index_metrics(p, []).collect()} == {"a": 0.4, "b": 0.8, "c": 0.8}


def test_catalog_round_trip(spark, tmp_path):
    x = spark.createDataFrame([("a", 1.0)], "track string, m double")
    assert K.load(spark, f"{tmp_path}/none") is None
    K.save(x, f"{tmp_path}/c")
    y = K.upsert(K.load(spark, f"{tmp_path}/c"), spark.createDataFrame([("a", 2.0), ("b", 3.0)], "track string, m double"))
    assert sorted((r.track, r.m) for r in y.collect()) == [("a", 2.0), ("b", 3.0)]


def test_catalog_versions(spark, tmp_path):
    at = f"{tmp_path}/c"
    for m in (1.0, 2.0, 3.0):
        old = K.load(spark, at)  # the table that is read while the next version is written
        K.save(K.upsert(old, spark.createDataFrame([("a", m), (f"t{m}", m)], "track string, m double")), at)
    assert {(r.track, r.m) for r in K.load(spark, at).collect()} == {("a", 3.0), ("t1.0", 1.0), ("t2.0", 2.0), ("t3.0", 3.0)}
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == ["v1", "v2"]
    (tmp_path / "c" / "v3").mkdir()  # a version that was not finished does not count
    assert K.load(spark, at).count() == 4 and K.load(spark, at, below=2).count() == 3
    stats = spark.read.parquet(f"{at}.stats").first()
    assert stats.track_count == 4 and stats.metric == "m"


def test_module_documents(spark, tmp_path):
    one = spark.createDataFrame([("a/b ü", 0.5, "C"), ("x", 0.7, "D")], "track string, mean_tension double, detected_key string")
    A.write_module(one, str(tmp_path), "harmony")
    A.write_module(spark.createDataFrame([("x", 0.9, "E")], one.schema), str(tmp_path), "harmony")
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "y_harmony.json").write_text('{"mean_tension": 0.1}')
    got = {r.track: (r.m, r.k) for r in A.read_module(spark, str(tmp_path), "harmony").select("track", A.metric("doc", "mean_tension").alias("m"), A.text_field("doc", "detected_key").alias("k")).collect()}
    assert got == {"a/b ü": (0.5, "C"), "x": (0.9, "E"), "y": (0.1, None)}
    rows = spark.createDataFrame([("x", 1.0, 5), ("x", 0.5, 6)], "track string, t double, n int")
    assert [(s.t, s.n) for s in A.as_stream(rows).first().stream] == [(0.5, 6), (1.0, 5)]


def test_analysis_files(spark, tmp_path):
    d = tmp_path / "x"
    d.mkdir()
    (d / "x_report.json").write_text(json.dumps({"duration_seconds": 200.0, "tempo_bpm": 120.0}))
    (d / "x_perception.json").write_text(json.dumps({"summary": {"mean_momentum": 0.85}}))
    (d / "x_melody.json").write_text("{broken")
    r = A.load_analysis(spark, str(tmp_path)).select("track", A.metric("report", "tempo_bpm").alias("t"), A.metric("perception", "mean_momentum").alias("m"), F.col("harmony").isNull().alias("h"), F.col("melody").isNull().alias("b")).first()
    assert tuple(r) == ("x", 120.0, 0.85, True, True)
    wide = K.rebuild(A.load_analysis(spark, str(tmp_path)), A.metric).first()
    assert (wide.track, wide.tempo_bpm, wide.mean_momentum, wide.mean_tension) == ("x", 120.0, 0.85, None)
    with pytest.raises(ValueError):
        A.resolve_template("nosuch")
    assert A.resolve_template("none") is None


@pytest.mark.parametrize("mode, has, lacks", [("full", "BG", "zz"), ("lyrics", "LY", "BG"), ("context", "BG", "LY"), ("blind", "ME", "HE")])
def test_modes(spark, mode, has, lacks):
    df = spark.createDataFrame([("BG", "HE", "ME", "LY", None)], "background string, header string, metrics string, lyrics string, frames string")
    got = df.select(P.packet(mode, background="background", header="header", metrics="metrics", lyrics="lyrics", frames="frames")).first()[0]
    assert has in got and lacks not in got and "ME" in got
    with pytest.raises(ValueError):
        P.packet("nosuch")


def test_prompt_sections(spark):
    row = {"duration_seconds": F.lit(200.0), "tempo_bpm": F.lit(120.0), "mean_major_minor": F.lit(-0.5), "hp_balance": F.lit(0.3)}
    text = spark.range(1).select(P.metrics(row)).first()[0]
    assert "Duration: 3:20 (200.0s)" in text and "minor-leaning" in text and "percussive dominant" in text
    got = spark.createDataFrame([('{"found": true, "extract": "E"}',), ('{"found": false, "extract": "E"}',), ("plain",)], "c string").select(P.context_text(F.col("c"))).collect()
    assert [g[0] for g in got] == ["E", None, "plain"]


def test_cards_and_labels(spark):
    v = spark.createDataFrame([("a", "tempo_bpm", 120.0), ("b", "tempo_bpm", 90.0), ("a", "mean_tension", 0.5)], "track string, metric string, value double")
    got = {r.track: r.card for r in K.summary_cards(v).collect()}
    assert "Tempo: 120.000 (rank 2/2, z=+1.0)" in got["a"] and got["a"].index("Tension: 0.500") < got["a"].index("Tempo")
    x = spark.createDataFrame([("silence", None, 2.0, -60.0, None, None), ("momentum_drop", 0.4, None, None, 0.9, 0.5), ("pattern_break", 0.25, None, None, None, None)], "type string, intensity double, duration double, depth_db double, `from` double, `to` double")
    texts = [r[0] for r in x.select(E.event_label(*[F.col(c) for c in x.columns])).collect()]
    assert texts == ["2.0s silence at -60dB", "momentum drop (0.900 → 0.500)", "pattern break (intensity 0.250)"]
