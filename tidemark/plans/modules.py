"""The five analyses of audio tracks: shared kernel features first, then DataFrame plans over them.

features() runs every signal kernel once per track and gives one row per track; persist or write it, as each
analysis explodes what it needs. Streams are on a half-second grid, overtones on every 21st frame.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import harmony as H
from ..functions import scalar as S
from ..operators import events as E
from ..operators import listening as L
from ..operators import signal as G
from ..operators import timeseries as T
from ..operators.overtones import match_harmonics

SECOND = G.HOP / G.SR  # seconds of a frame
STEP = 0.5
#: Columns of features(): one row per track.
FEATURES = """track string, duration double, tempo double, beats array<double>, onsets array<double>, rms array<double>, fine_rms array<double>,
flux array<double>, h_rms array<double>, p_rms array<double>, centroid double, zcr double, chroma array<array<double>>,
f0 array<double>, voiced array<double>, overtones array<struct<frame: bigint, f0: double, peaks: array<struct<freq: double, mag: double>>>>, bounds array<double>"""


def _features(track: str, y: np.ndarray, use_harmonic: bool = True) -> dict:
    s = G.stft(y)
    h, p = G.hpss(s)
    scale = np.sqrt(2.0) / G.FRAME  # from a Hann frame's spectrum back to its energy, to first order
    band = lambda m: (np.sqrt((m * m).sum(1) * 2 / 0.375) * scale / np.sqrt(2.0)).tolist()
    freq = G.frequencies()
    strength = G.onset_strength(y)
    tempo, beats = G.beats(strength)
    f0, voiced = G.pitch(G.harmonic_part(y) if use_harmonic else y, 60.0, 2000.0)
    low, _ = G.pitch(y, 50.0, 500.0)
    frames = np.arange(0, len(low), int(STEP / SECOND))
    wide = G.stft(y, 8192, G.HOP, frames[frames < len(s)])
    wf = G.frequencies(8192)
    over = []
    for i, row in zip(frames, wide, strict=False):
        f, m = G.spectral_peaks(row, wf) if np.isfinite(low[i]) else ((), ())
        over.append({"frame": int(i), "f0": float(low[i]) if np.isfinite(low[i]) else None, "peaks": [{"freq": float(a), "mag": float(b)} for a, b in zip(f, m, strict=True)]})
    seconds = len(y) / G.SR
    return {
        "track": track, "duration": seconds, "tempo": tempo, "beats": beats.tolist(), "onsets": G.onsets(strength).tolist(),
        "rms": G.rms(y).tolist(), "fine_rms": G.rms(y, 1024, 256).tolist(), "flux": np.sqrt((np.diff(s, axis=0) ** 2).mean(1)).tolist(),
        "h_rms": band(h), "p_rms": band(p), "centroid": float(G.centroid(s, freq).mean()), "zcr": float(G.zero_crossings(y).mean()),
        "chroma": G.chroma(y).tolist(), "f0": [float(x) if np.isfinite(x) else None for x in f0], "voiced": voiced.tolist(), "overtones": over, "bounds": G.segments(s, seconds),
    }


def features(signals: DataFrame, use_harmonic: bool = True) -> DataFrame:
    """One row per track of (track, y) signals; run split_null() before, so that silent tracks stop there.

    ``use_harmonic``: the melody's pitch is taken from the harmonic part of the signal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                track, samples = batch.column(0)[i].as_py(), batch.column(1)[i].values
                if samples is None or not len(samples):
                    raise ValueError(f"track {track!r} has no duration")
                yield pa.RecordBatch.from_pylist([_features(track, samples.to_numpy(zero_copy_only=False), use_harmonic)], schema=schema)

    kinds = StructType.fromDDL(FEATURES)
    schema = to_arrow_schema(kinds)
    return signals.select("track", "y").mapInArrow(run, kinds)


def _series(f: DataFrame, column: str, out: str, second: float = SECOND) -> DataFrame:
    """(track, frame, t, out) of an array column."""
    x = f.select("track", F.posexplode(column).alias("frame", out))
    return x.withColumn("frame", F.col("frame").cast("long")).withColumn("t", F.col("frame") * second)


def _grid(f: DataFrame) -> DataFrame:
    return T.grid(f.select("track", "duration"), STEP)


def _join(frames: list[DataFrame]) -> DataFrame:
    """Grid streams side by side."""
    return reduce(lambda a, b: a.join(b.drop("t"), ["track", "i"]), frames)


def segment_energies(f: DataFrame, second: float = SECOND) -> DataFrame:
    """(track, segments): structural segments with the mean and largest energy of the frames in [start, end); empty ones are left out."""
    marks = f.select("track", F.posexplode("bounds").alias("k", "t")).select("track", "t", "k", F.lead("t").over(Window.partitionBy("track").orderBy("k")).alias("end"))
    marks = marks.where("end IS NOT NULL").withColumn("span", F.struct("k", F.col("t").alias("start"), "end"))
    frames = _series(f, "rms", "rms", second).select("track", F.col("frame").alias("i"), "t", "rms")
    inside = T.asof(frames, marks, "span").where("span IS NOT NULL AND t < span.end").join(frames.drop("t"), ["track", "i"])
    each = inside.groupBy("track", "span").agg(F.round(F.avg("rms"), 6).alias("mean_energy"), F.round(F.max("rms"), 6).alias("peak_energy"))
    row = F.struct("span.k", F.round("span.start", 2).alias("start"), F.round("span.end", 2).alias("end"), "mean_energy", "peak_energy")
    return each.groupBy("track").agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: r.dropFields("k")).alias("segments"))


def report(f: DataFrame, second: float = SECOND) -> DataFrame:
    """Track features and their labels, one row per track; ``second`` is a frame's length."""
    beats = f.select("track", F.explode("beats").alias("t"))
    arc = _series(f, "rms", "rms").withColumn("_n", F.floor(F.count("*").over(Window.partitionBy("track")) / 10))
    arc = arc.withColumn("segment", F.when(F.col("_n") > 0, F.floor(F.col("frame") / F.greatest("_n", F.lit(1)))).otherwise(0)).where("segment < 10")
    arc = arc.groupBy("track", "segment").agg(F.round(F.avg("rms"), 6).alias("mean_energy"), F.round(F.max("rms"), 6).alias("peak_energy")).groupBy("track").agg(F.sort_array(F.collect_list(F.struct("segment", "mean_energy", "peak_energy"))).alias("energy_arc"))
    sums = F.aggregate("chroma", F.array(*[F.lit(0.0)] * 12), lambda a, c: F.zip_with(a, c, lambda x, y: x + y))  # in order of frames
    top = f.where(F.size("chroma") > 0).select("track", F.sort_array(F.transform(sums, lambda e, k: F.struct(e.alias("e"), (-k).alias("k")))).alias("_c"))
    names = F.array(*map(F.lit, S.NOTES))
    top = top.select("track", F.transform(F.slice(F.reverse("_c"), 1, 3), lambda c: F.element_at(names, 1 - c.k)).alias("dominant_chroma"))
    mean = lambda c: F.try_divide(H.total(F.col(c)), F.size(c).cast("double"))
    x = f.join(T.regularity(beats), "track", "left").join(arc, "track", "left").join(top, "track", "left").join(segment_energies(f, second), "track", "left")
    positive = F.filter("rms", lambda v: v > 0)
    x = x.withColumns({
        "beat_regularity": F.coalesce("beat_regularity", F.lit(0.0)), "harmonic_energy": mean("h_rms"), "percussive_energy": mean("p_rms"),
        "dynamic_range_ratio": F.coalesce(F.try_divide(F.array_max("rms"), F.array_min(positive)), F.lit(0.0)), "onsets_per_second": F.size("onsets") / F.col("duration"),
    }).withColumn("percussion_ratio", S.percussion_ratio(F.col("harmonic_energy"), F.col("percussive_energy")))
    return x.select(
        "track", F.col("duration").alias("duration_seconds"), S.scaled_round(F.col("tempo"), 1).alias("tempo_bpm"), F.size("beats").cast("long").alias("beat_count"), S.scaled_round(F.col("beat_regularity"), 4).alias("beat_regularity"),
        S.scaled_round(F.col("percussion_ratio"), 4).alias("percussion_ratio"), "harmonic_energy", "percussive_energy", S.scaled_round(F.col("centroid"), 1).alias("spectral_centroid_mean_hz"), F.size("onsets").cast("long").alias("onset_count"),
        S.scaled_round(F.col("onsets_per_second"), 3).alias("onsets_per_second"), S.scaled_round(F.col("zcr"), 4).alias("mean_zcr"), S.scaled_round(F.col("dynamic_range_ratio"), 2).alias("dynamic_range_ratio"), "energy_arc", "dominant_chroma", "segments",
        S.rhythm_label(F.col("beat_regularity")).alias("rhythm"), S.character_label(F.col("percussion_ratio")).alias("character"), S.brightness_label(F.col("centroid")).alias("brightness"),
        S.dynamics_label(F.col("dynamic_range_ratio")).alias("dynamics"), S.texture_label(F.col("onsets_per_second")).alias("texture"),
    )


#: Columns of features() that heard() reads.
HEARS = ["track", "duration", "beats", "rms", "h_rms", "p_rms", "flux", "fine_rms"]


def heard(f: DataFrame, second: float = SECOND) -> DataFrame:
    """One row per track with the curves of its grid, its events in order and their means (listening.HEARD)."""
    kinds = StructType.fromDDL(L.HEARD)
    schema, fine = to_arrow_schema(kinds), second * 256 / G.HOP
    untimed = F.col("untimed") if "untimed" in f.columns else F.lit(0)  # beats without a time
    return f.select(*HEARS, untimed.cast("long")).mapInArrow(lambda batches: L.hear(batches, schema, second, fine), kinds)


def perception(f: DataFrame, second: float = SECOND) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stream, events, summary) of every track."""
    h = heard(f, second)
    points = h.select("track", F.posexplode(F.arrays_zip(*L.CURVES, "silence", "silence_depth_db")).alias("i", "x")).select("track", F.col("i").cast("long").alias("i"), (F.col("i") * STEP).alias("t"), "x.*")
    x = points.withColumn("hp_balance", S.hp_balance(F.col("h_energy"), F.col("p_energy"), 0.005))
    stream = E.edge_flags(x).select(
        "track", "i", F.round("t", 1).alias("t"), F.round("energy", 4).alias("energy"), F.round("momentum", 3).alias("momentum"), F.round(1 - F.col("disruption"), 3).alias("pattern_lock"), F.round("breath", 3).alias("breath"),
        F.round("hp_balance", 3).alias("hp_balance"), F.round("h_energy", 4).alias("h_energy"), F.round("p_energy", 4).alias("p_energy"), "silence", "silence_depth_db", "event",
    )
    events = h.select("track", F.posexplode("events").alias("place", "e")).select("track", "e.*", (F.col("place") + 1).cast("long").alias("seq"))
    of = lambda k: F.filter("events", lambda e: e.type == k)
    total = F.aggregate(of("silence"), F.lit(0).cast("decimal(28,2)"), lambda a, e: (a + e.duration.cast("decimal(18,2)")).cast("decimal(28,2)"))
    s = h.withColumns({"total_silence_sec": F.round(total, 1).cast("double"), "momentum_range": F.when(F.col("momentum_min").isNotNull(), F.array("momentum_min", "momentum_max"))})
    counts = F.create_map(*[y for k in E.TYPES for y in (F.lit(k), F.size(of(k)).cast("long"))])
    summary = s.select(
        "track", "duration", *L.MEANS[:4], "momentum_range", *L.MEANS[6:], "total_silence_sec", counts.alias("pattern_break_counts"), F.size("events").cast("long").alias("pattern_break_count"),
        F.round(F.try_divide(100 * F.col("total_silence_sec"), F.col("duration")), 1).alias("silence_pct"), F.round(F.col("duration") - F.col("total_silence_sec"), 1).alias("active_duration_sec"),
    )
    return stream, events, summary


def tonal_centres(f: DataFrame, size: int = 50, second: float = SECOND) -> DataFrame:
    """(track, t, centre): hopping windows of ``size`` frames by half, their mean chroma's key, its stability and major-minor balance."""
    hop = size // 2
    x = f.select("track", F.size("chroma").alias("_n"), "chroma", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("chroma") - size) / hop).cast("int")))).alias("k"))
    part = F.slice("chroma", F.col("k") * hop + 1, size)
    of = lambda p: F.transform(part, lambda c: c[p])
    mean = F.array(*[H.total(of(p)) / F.size(part) for p in range(12)])
    x = x.select("track", "k", "_n", mean.alias("chroma")).withColumn("key", H.detect_key(F.col("chroma"))).withColumn("_s", H.total(F.col("chroma")))
    at = lambda s: F.col("chroma")[F.pmod(F.col("key.root") + s, F.lit(12))] / F.col("_s")
    known = F.col("key.root") >= 0
    return x.select(
        "track", (F.least(F.col("k") * hop + hop, F.col("_n") - 1) * second).alias("t"),
        F.struct(F.col("key.key").alias("tonal_center"), F.col("key.confidence").alias("key_confidence"), F.when(known, at(0)).otherwise(0.0).alias("tonal_stability"), F.when(known, at(4) - at(3)).otherwise(0.0).alias("major_minor")).alias("centre"),
    )


def harmony(f: DataFrame, second: float = SECOND) -> tuple[DataFrame, DataFrame]:
    """(stream, summary): consonances, tension, chroma flux, tonal centre, key."""
    grid = _grid(f)
    raw = _series(f, "chroma", "chroma", second)
    w = Window.partitionBy("track").orderBy("frame")
    named = {f"_c{p}": F.col("chroma")[p] for p in range(12)} | {f"_z{j}": F.get(F.col("_t"), F.lit(j)) for j in range(6)}
    wide = raw.withColumn("_t", H.tonnetz(F.col("chroma"))).withColumns(named).drop("chroma", "_t")
    wide = T.moving_average(wide, list(named), 8, [f"s{n}" for n in named])
    both = wide.select("track", "frame", "t", F.array(*[f"s_c{p}" for p in range(12)]).alias("smooth"), F.array(*[f"s_z{j}" for j in range(6)]).alias("z"))
    x = both.select("track", "frame", "t", H.temperament(F.col("smooth")).alias("temperament_alignment"), H.series(F.col("smooth")).alias("consonance_series"), F.coalesce(H.cosine_distance(F.col("smooth"), F.lead("smooth").over(w)), F.lit(0.0)).alias("_flux"))
    z = both.withColumn("_v", F.coalesce(H.norm(F.zip_with(F.lead("z").over(w), "z", lambda a, b: a - b)), F.lit(0.0)))
    tension = T.max_normalised(T.moving_average(z.select("track", "frame", "t", "_v"), "_v", 10, "tension"), "tension").select("track", "frame", "t", "tension")
    flux = T.max_normalised(T.window_average(x.select("track", "t", "_flux"), grid, "_flux", 8.0, STEP), "_flux").withColumnRenamed("_flux", "chroma_flux")
    centres = tonal_centres(f, second=second)
    first = centres.groupBy("track").agg(F.min_by("centre", "t").alias("_first"))
    centre = T.asof(grid, centres, "centre").join(first, "track", "left").select("track", "i", F.coalesce("centre", "_first").alias("centre"))
    joined = _join([T.interpolate(grid, x, ["temperament_alignment", "consonance_series"]), T.interpolate(grid, tension, "tension"), flux]).join(centre, ["track", "i"], "left")
    r3 = lambda c: F.round(c, 3)
    stream = joined.select("track", "i", F.round("t", 1).alias("t"), *[r3(c).alias(c) for c in ("temperament_alignment", "consonance_series", "tension", "chroma_flux")], "centre.tonal_center", r3("centre.tonal_stability").alias("tonal_stability"), r3("centre.key_confidence").alias("key_confidence"), r3("centre.major_minor").alias("major_minor"))
    key = raw.groupBy("track").agg(F.array(*[F.avg(F.col("chroma")[p]) for p in range(12)]).alias("c")).select("track", H.detect_key(F.col("c")).alias("k"))
    own = x.groupBy("track").agg(F.avg("temperament_alignment").alias("mean_temperament_alignment"), F.avg("consonance_series").alias("mean_consonance_series"))
    ten = tension.groupBy("track").agg(F.avg("tension").alias("mean_tension"))
    fl = flux.groupBy("track").agg(F.avg("chroma_flux").alias("mean_chroma_flux"))
    ce = centres.groupBy("track").agg(F.avg("centre.tonal_stability").alias("mean_tonal_stability"), F.avg("centre.major_minor").alias("mean_major_minor"))
    summary = key.join(own, "track").join(ten, "track", "left").join(fl, "track", "left").join(ce, "track", "left")
    return stream, summary.select("track", F.col("k.key").alias("detected_key"), F.col("k.mode").alias("detected_mode"), F.col("k.confidence").alias("key_confidence"), *[F.round(c, 4).alias(c) for c in summary.columns if c.startswith("mean_")])


def melody(f: DataFrame, second: float = SECOND) -> tuple[DataFrame, DataFrame]:
    """(stream, summary): pitch, contour direction, range, presence."""
    grid = _grid(f)
    p = f.select("track", F.posexplode(F.arrays_zip("f0", "voiced")).alias("frame", "p")).select("track", "frame", (F.col("frame") * second).alias("t"), "p.f0", F.col("p.voiced").alias("prob"))
    p = p.withColumn("midi", S.hz_to_midi(F.col("f0")))
    sung = p.where("midi IS NOT NULL")
    two = F.count("*") >= 2
    way = T.in_windows(sung, 1.0, 1.0, STEP).groupBy("track", "i").agg(F.when(F.count("*") >= 3, F.regr_slope("midi", "t")).otherwise(0.0).alias("direction"))
    span = T.in_windows(sung, 2.0, 2.0, STEP).groupBy("track", "i").agg(F.when(two, F.max("midi") - F.min("midi")).otherwise(0.0).alias("pitch_range_st"), F.when(two, F.median("midi")).alias("pitch_center_midi"))
    here = T.window_average(p, grid, "prob", 2.0, STEP).withColumnRenamed("prob", "vocal_presence")
    near = T.asof(grid, p, "f0").drop("t", "_at")
    prob = T.interpolate(grid, p.select("track", "t", "prob"), "prob").drop("t")
    x = here.join(way, ["track", "i"], "left").join(span, ["track", "i"], "left").join(near, ["track", "i"], "left").join(prob, ["track", "i"], "left")
    sings = F.col("prob") > 0.5
    direction = F.coalesce("direction", F.lit(0.0))
    stream = x.select(
        "track", "i", F.round("t", 1).alias("t"), F.when(sings, F.round("f0", 2)).alias("f0_hz"), F.when(sings & F.col("f0").isNotNull(), S.hz_to_note(F.col("f0"))).alias("note"), F.when(sings, F.round(direction, 3)).alias("direction"),
        F.round(F.coalesce("pitch_range_st", F.lit(0.0)), 2).alias("pitch_range_st"), F.when(sings, F.round("pitch_center_midi", 2)).alias("pitch_center_midi"), F.round("vocal_presence", 3).alias("vocal_presence"),
    )
    loud = F.when(F.col("vocal_presence") > 0.3, direction)
    share = lambda c: F.coalesce(F.avg(F.when(loud.isNotNull(), c.cast("int"))) * 100, F.lit(0.0))
    shape = x.groupBy("track").agg(F.avg("vocal_presence").alias("_p"), F.avg(direction).alias("_d"), share(loud > 0.5).alias("_a"), share(loud < -0.5).alias("_f"), F.count(loud).alias("_n"), F.count("*").alias("stream_length"))
    whole = sung.groupBy("track").agg((F.max("midi") - F.min("midi")).alias("_r"), F.median("f0").alias("_m"), F.min("f0").alias("_lo"), F.max("f0").alias("_hi"))
    y = f.select("track", "duration").join(shape, "track").join(whole, "track", "left")
    held = F.when(F.col("_n") > 0, 100 - F.col("_a") - F.col("_f")).otherwise(0.0)
    r1 = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 1)
    return stream, y.select(
        "track", F.round("duration", 1).alias("duration"), r1(F.col("_r")).alias("overall_range_semitones"), r1(F.col("_m")).alias("overall_center_hz"), S.hz_to_note(F.col("_m")).alias("overall_center_note"),
        S.hz_to_note(F.col("_lo")).alias("range_low"), S.hz_to_note(F.col("_hi")).alias("range_high"), F.round("_p", 3).alias("mean_vocal_presence"), r1(F.col("_a")).alias("contour_ascending_pct"),
        r1(F.col("_f")).alias("contour_descending_pct"), r1(held).alias("contour_holding_pct"), F.round("_d", 3).alias("mean_direction"), "stream_length",
    )


def overtones(f: DataFrame, second: float = SECOND) -> tuple[DataFrame, DataFrame]:
    """(stream, summary): each sampled frame's harmonics with their fit, richness and dominant; per-harmonic profile and histogram."""
    frames = f.select("track", F.explode("overtones").alias("o")).select("track", "o.frame", "o.f0", "o.peaks")
    m = match_harmonics(frames.where("f0 IS NOT NULL AND size(peaks) > 0"))
    one = F.struct(F.col("magnitude").alias("magnitude"), F.col("cents").alias("deviation_cents"))
    by = m.groupBy("track", "frame").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("n", one.alias("h"))))).alias("harmonics"), F.count("*").alias("_k"), F.avg("cents").alias("inharmonicity"),
        F.max_by("n", F.when(F.col("n") > 1, F.struct("magnitude", (-F.col("n")).alias("k")))).alias("dominant_harmonic"), F.count_if(F.col("n") > 1).alias("_over"),
    )
    x = frames.drop("peaks").join(by, ["track", "frame"], "left")
    rich = F.coalesce(F.col("_k") / F.nullif(F.least(F.lit(16), F.floor(10_000 / F.greatest("f0", F.lit(1.0)))), F.lit(0)), F.lit(0.0))
    fit = rich * F.greatest(F.lit(0.0), 1 - F.col("inharmonicity") / 50)
    sung = F.col("f0").isNotNull()
    stream = x.select(
        "track", F.round(F.col("frame") * second, 2).alias("t"), F.round("f0", 2).alias("f0"), "harmonics", F.when(sung, F.round(F.coalesce(fit, F.lit(0.0)), 3)).alias("series_fit"), F.when(sung, F.round(F.coalesce("inharmonicity", F.lit(0.0)), 2)).alias("inharmonicity"),
        F.when(sung, F.round(rich, 3)).alias("richness"), F.when(F.col("_over") > 0, F.col("dominant_harmonic")).alias("dominant_harmonic"),
    )
    mean = lambda c: F.coalesce(F.round(F.avg(F.col(c).cast("decimal(18,3)")), 4).cast("double"), F.lit(0.0))  # noqa: E731  of numbers with at most three decimals
    whole = stream.groupBy("track").agg(F.count("*").alias("total_frames"), F.count("f0").alias("voiced_frames"), mean("series_fit").alias("mean_series_fit"), mean("richness").alias("mean_richness"), mean("inharmonicity").alias("mean_inharmonicity"), F.max("t").alias("duration"))
    top = stream.where("dominant_harmonic IS NOT NULL").groupBy("track", "dominant_harmonic").agg(F.count("*").alias("c")).groupBy("track").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dominant_harmonic", "c")))).alias("dominant_histogram"))
    prof = m.groupBy("track", "n").agg(F.count("*").alias("c"), F.avg("magnitude").alias("mean_magnitude")).join(whole.select("track", "voiced_frames"), "track")
    prof = prof.groupBy("track").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("n", F.struct(F.round(100 * F.col("c") / F.col("voiced_frames"), 1).alias("presence_pct"), F.round("mean_magnitude", 4).alias("mean_magnitude")).alias("v"))))).alias("harmonic_profile"))
    return stream, whole.join(top, "track", "left").join(prof, "track", "left")


def analyse(signals: DataFrame, only: list[str] | None = None, skip: list[str] | None = None) -> dict[str, tuple[DataFrame, ...]]:
    """The chosen analyses (report, perception, harmony, melody, overtone) of (track, y) signals; unknown names raise ValueError."""
    every = {"report": lambda f: (report(f),), "perception": perception, "harmony": harmony, "melody": melody, "overtone": overtones}
    if unknown := {*(only or []), *(skip or [])} - every.keys():
        raise ValueError(f"unknown modules {sorted(unknown)}; choose from {', '.join(every)}")
    f = features(signals).persist()
    return {k: run(f) for k, run in every.items() if (not only or k in only) and k not in (skip or [])}


def visual_plan(perception_events: DataFrame, report_: DataFrame | None, perception_: DataFrame | None, target: int = 12, anchor_ratio: float = 0.6) -> DataFrame:
    """Timestamps for frames: events clustered, the best of each ranked, the duration from the report or else the perception summary."""
    a = report_.select("track", F.col("duration_seconds").alias("_a")) if report_ is not None else None
    b = perception_.select("track", F.col("duration").alias("_b")) if perception_ is not None else None
    if a is None and b is None:
        raise ValueError("needs a report or a perception summary")
    d = a.join(b, "track", "full") if a is not None and b is not None else (a if a is not None else b)
    d = d.select("track", F.coalesce(*[c for c in ("_a", "_b") if c in d.columns]).alias("duration"))
    best = E.best_of_clusters(T.clusters(perception_events.withColumnRenamed("time", "t")))
    return E.select_frames(best, d, target, anchor_ratio)

