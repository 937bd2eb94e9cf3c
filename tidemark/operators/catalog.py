"""Cross-track catalog: long form, statistics, rank, extremes, comparison, legacy keys, upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Metrics of each analysis module that are compared; fixed values.
COMPARED = {
    "report": ["duration_seconds", "tempo_bpm", "beat_count", "beat_regularity", "percussion_ratio", "harmonic_energy", "percussive_energy", "spectral_centroid_mean_hz", "onset_count", "onsets_per_second", "mean_zcr", "dynamic_range_ratio"],
    "perception": ["mean_momentum", "mean_pattern_lock", "total_silence_sec", "pattern_break_count", "breath_positive_pct", "breath_negative_pct", "breath_sustain_pct"],
    "harmony": ["mean_temperament_alignment", "mean_consonance_series", "mean_tension", "mean_chroma_flux", "mean_tonal_stability", "mean_major_minor", "key_confidence"],
    "melody": ["overall_range_semitones", "mean_vocal_presence", "contour_ascending_pct", "contour_descending_pct", "contour_holding_pct", "mean_direction"],
    "overtone": ["mean_series_fit", "mean_richness", "mean_inharmonicity", "voiced_frames", "total_frames"],
}
ACTIVE_FROM = 10.0  # percent of silence from which the active-frame metrics are indexed


def long_form(wide: DataFrame, key: str = "track") -> DataFrame:
    """(track, metric, value) of the numeric columns; nulls left out."""
    numeric = [c for c, t in wide.dtypes if c != key and t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
    x = wide.select(F.col(key).alias("track"), *[F.col(c).cast("double").alias(c) for c in numeric])
    return x.unpivot("track", numeric, "metric", "value").where("value IS NOT NULL")


def flatten(modules: dict[str, DataFrame]) -> DataFrame:
    """(track, metric, value) of the compared metrics of module tables (one row per track each); modules may lack."""
    out = None
    for name, df in modules.items():
        have = [c for c in COMPARED[name] if c in df.columns]
        part = long_form(df.select("track", *have))
        out = part if out is None else out.unionByName(part)
    return out


def stats(values: DataFrame) -> DataFrame:
    """Per metric with two values or more: mean, population std, min, max, median (four decimals), count."""
    r = lambda c: F.round(c, 4)
    agg = values.groupBy("metric").agg(
        r(F.avg("value")).alias("mean"), r(F.stddev_pop("value")).alias("std"), r(F.min("value")).alias("min"), r(F.max("value")).alias("max"), r(F.median("value")).alias("median"), F.count("value").alias("n")
    )
    return agg.where("n >= 2")


BUCKETS = 64  # ranges of a metric's values that are ranked apart


def rank(values: DataFrame) -> DataFrame:
    """rank (1 + number below), percentile and z-score of every value; metrics with fewer than two values are left out.

    Distinct values are counted before they are ordered, and a metric's are ordered in BUCKETS ranges, each a window of
    its own that starts at the number of values below it: neither a metric nor a value that many tracks share meets
    in one task. The ranges' bounds (BUCKETS numbers a metric) pass through the driver, so that one cut holds throughout.
    """
    spark = values.sparkSession
    whole = values.groupBy("metric").agg(F.count("*").alias("of"), F.round(F.avg("value"), 4).alias("m"), F.round(F.stddev_pop("value"), 4).alias("s")).where("of >= 2")
    shares = [i / BUCKETS for i in range(1, BUCKETS)]
    cuts = [(r["metric"], sorted(set(r["b"]))) for r in values.groupBy("metric").agg(F.percentile_approx("value", shares, F.lit(1000)).alias("b")).collect()]
    cuts = F.broadcast(spark.createDataFrame(cuts, "metric string, _b array<double>"))
    counted = values.groupBy("metric", "value").agg(F.count("*").alias("_c")).join(cuts, "metric")
    counted = counted.select("metric", "value", "_c", F.size(F.filter("_b", lambda b: b <= F.col("value"))).alias("_p"))
    inside = F.sum("_c").over(Window.partitionBy("metric", "_p").orderBy("value")) - F.col("_c")
    parts = counted.groupBy("metric", "_p").agg(F.sum("_c").alias("_n"))
    parts = parts.select("metric", "_p", (F.sum("_n").over(Window.partitionBy("metric").orderBy("_p")) - F.col("_n")).alias("_before"))
    ranked = counted.withColumn("_in", inside).join(parts, ["metric", "_p"]).select("metric", "value", (F.col("_before") + F.col("_in") + 1).alias("rank"))
    x = values.select("track", "metric", "value").join(ranked, ["metric", "value"]).join(whole, "metric")
    z = F.when(F.col("s") > 0, F.round((F.col("value") - F.col("m")) / F.nullif("s", F.lit(0.0)), 2)).otherwise(0.0)
    share = F.round((F.col("rank") - 1) / (F.col("of") - 1) * 100, 1)
    return x.select("track", "metric", "value", F.col("rank").cast("long").alias("rank"), "of", share.alias("percentile"), z.alias("z_score"))


def extremes(values: DataFrame, n: int = 3) -> DataFrame:
    """The n lowest and n highest tracks of each metric; ties by track."""
    low = F.row_number().over(Window.partitionBy("metric").orderBy("value", "track"))
    high = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), "track"))
    side = lambda w, name: values.withColumn("place", w.cast("long")).where(F.col("place") <= n).withColumn("side", F.lit(name))
    return side(low, "lowest").unionByName(side(high, "highest"))


def compare(values: DataFrame, a: str, b: str) -> DataFrame:
    """Metric by metric: values of a and b, delta, divergence |b - a| / max(|a|, |b|, 0.001), where found (both, only_a, only_b)."""
    va = values.where(F.col("track") == a).select("metric", F.col("value").alias("a"))
    vb = values.where(F.col("track") == b).select("metric", F.col("value").alias("b"))
    d = F.abs(F.col("b") - F.col("a")) / F.greatest(F.abs("a"), F.abs("b"), F.lit(0.001))
    found = F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").otherwise("both")
    return va.join(vb, "metric", "full").select("metric", "a", "b", (F.col("b") - F.col("a")).alias("delta"), d.alias("divergence"), found.alias("found"))


def legacy_names(wide: DataFrame) -> DataFrame:
    """Old column names read as the new ones (a present new value wins, also when it is 0), dead ones dropped."""
    for old, new in (("moment_count", "pattern_break_count"), ("mean_consonance", "mean_temperament_alignment"), ("mean_surprise", "mean_pattern_lock")):
        if old in wide.columns:
            wide = wide.withColumn(new, F.coalesce(new, old) if new in wide.columns else F.col(old)).drop(old)
    return wide.drop("top_chords", "primary_tonal_center", "mean_harmonic_rhythm")


def index_metrics(perception: DataFrame, others: list[DataFrame]) -> DataFrame:
    """One wide row per track from module tables; momentum and pattern lock of active frames where silence reaches ACTIVE_FROM percent."""
    quiet = F.coalesce("silence_pct", F.lit(0.0)) >= ACTIVE_FROM
    out = perception
    for name in ("mean_momentum", "mean_pattern_lock"):
        if f"{name}_active" in perception.columns:
            out = out.withColumn(name, F.when(quiet, F.coalesce(f"{name}_active", name)).otherwise(F.col(name)))
    for df in others:
        out = out.join(df, "track", "full")
    return out


def upsert(old: DataFrame | None, new: DataFrame, order: str | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` of the same track."""
    return new if old is None else old.join(new.select("track"), "track", "left_anti").unionByName(new, allowMissingColumns=True)


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, place) of the complete versions below ``path``, the newest last."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [str(s.getPath()) for s in fs.listStatus(at) if s.isDirectory()]
    names = [(int(n), p) for p in found if (n := p.rsplit("/v", 1)[-1]).isdigit()]
    return sorted((n, p) for n, p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS")))


def load(spark: SparkSession, path: str, legacy: str | None = None, below: int | None = None) -> DataFrame | None:
    """The newest version of the catalog at ``path`` (before version ``below``), else a plain table there, else the legacy table with its names read anew, else None."""
    kept = [p for n, p in _versions(spark, path) if below is None or n < below]
    if kept:
        return legacy_names(spark.read.parquet(kept[-1]))
    for place in (path, legacy):
        if place:
            try:
                return legacy_names(spark.read.parquet(place))
            except Exception as e:
                if not any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
                    raise
    return None


def save(catalog: DataFrame, path: str, version: int | None = None) -> None:
    """``catalog`` as a new version below ``path``, and beside it its statistics with the number of tracks.

    A version counts once it is complete, so a failure leaves the one before in place, which ``catalog`` may still be
    reading; the last two are kept.
    """
    spark = catalog.sparkSession
    old = _versions(spark, path)
    version = version if version is not None else (old[-1][0] + 1 if old else 0)
    catalog.write.mode("overwrite").parquet(f"{path}/v{version}")
    fresh = spark.read.parquet(f"{path}/v{version}")
    stats(long_form(fresh)).withColumn("track_count", F.lit(fresh.count())).write.mode("overwrite").parquet(f"{path}.stats")
    jvm = spark.sparkContext._jvm
    for n, place in old:
        if n < version - 1:
            at = jvm.org.apache.hadoop.fs.Path(place)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: The metrics that a catalog row keeps of each module, and the labels of those that a card shows; fixed values.
INDEXED = {
    "perception": ["mean_momentum", "mean_pattern_lock", "total_silence_sec", "silence_pct", "active_duration_sec", "pattern_break_count", "breath_positive_pct", "breath_negative_pct", "breath_sustain_pct"],
    "harmony": ["mean_temperament_alignment", "mean_consonance_series", "mean_tension", "mean_chroma_flux", "mean_tonal_stability", "mean_major_minor", "key_confidence"],
    "melody": ["overall_range_semitones", "mean_vocal_presence", "contour_ascending_pct", "contour_descending_pct", "mean_direction"],
    "overtone": ["mean_series_fit", "mean_richness", "mean_inharmonicity"],
    "report": ["duration_seconds", "tempo_bpm", "beat_regularity", "percussion_ratio", "spectral_centroid_mean_hz"],
}
#: Text fields that a catalog row keeps beside them; fixed values.
TEXTS = {"harmony": ["detected_key", "detected_mode"], "melody": ["overall_center_note"]}
#: Label and description of each card metric, in order; fixed values.
CARD = {
    "mean_pattern_lock": ("Pattern Lock", "higher = stronger pattern lock"),
    "mean_momentum": ("Momentum", "higher = more locked in (active frames when silence >= 10%)"),
    "silence_pct": ("Silence %", "fraction of track that is silence"),
    "active_duration_sec": ("Active Duration", "seconds of non-silent audio"),
    "mean_temperament_alignment": ("Temperament Alignment", "higher = more aligned with equal temperament"),
    "mean_consonance_series": ("Series Consonance", "higher = closer to harmonic series (JI)"),
    "mean_tension": ("Tension", "higher = more harmonic movement"),
    "mean_chroma_flux": ("Chroma Flux", "higher = faster harmonic change"),
    "overall_range_semitones": ("Melodic Range", "semitones"),
    "mean_vocal_presence": ("Vocal Presence", "0-1"),
    "mean_series_fit": ("Overtone Fit", "higher = purer harmonic series"),
    "mean_richness": ("Overtone Richness", "fraction of harmonics present"),
    "beat_regularity": ("Beat Regularity", "1.0 = metronomic"),
    "key_confidence": ("Key Confidence", "KK profile correlation"),
    "tempo_bpm": ("Tempo", "BPM"),
}


def summary_cards(values: DataFrame, card: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(track, card): a line for each card metric with its value, rank and z-score; metrics of one track alone show the value."""
    card = card or CARD
    r = rank(values).select("track", "metric", F.format_string(" (rank %d/%d, z=%s%.1f)", F.col("rank"), F.col("of"), F.when(F.col("z_score") < 0, "-").otherwise("+"), F.abs(F.round("z_score", 1))).alias("_r"))
    words = F.create_map(*[x for k, (a, b) in card.items() for x in (F.lit(k), F.struct(F.lit(a).alias("label"), F.lit(b).alias("about")))])
    place = F.array_position(F.array(*map(F.lit, card)), F.col("metric"))
    x = values.where(F.col("metric").isin(list(card))).join(r, ["track", "metric"], "left")
    word = words[F.col("metric")]
    line = F.concat(F.lit("  "), word.label, F.format_string(": %.3f", F.round("value", 3)), F.coalesce("_r", F.lit("")), F.lit(" -- "), word.about)
    lines = F.transform(F.sort_array(F.collect_list(F.struct(place.alias("p"), line.alias("x")))), lambda s: s.x)
    return x.groupBy("track").agg(F.concat(F.lit("=== "), F.first("track").cast("string"), F.lit(" -- Catalog Position ===\n\n"), F.array_join(lines, "\n")).alias("card"))


def rebuild(analysis: DataFrame, metric, text=None) -> DataFrame:
    """One wide row per track from (track, one variant for each module); ``metric(module, name)`` reads a number of a module's document, ``text`` a text.

    Tracks without any module are left out; older names count where the new ones lack.
    """
    modules = [c for c in INDEXED if c in analysis.columns]
    some = analysis.where(F.coalesce(*[F.col(m).isNotNull().cast("int") for m in modules], F.lit(0)).isNotNull() & F.greatest(*[F.col(m).isNotNull().cast("int") for m in modules], F.lit(0)).cast("boolean"))
    older = {"mean_pattern_lock": "mean_surprise", "mean_temperament_alignment": "mean_consonance", "pattern_break_count": "moment_count"}
    cols = {n: F.coalesce(metric(m, n), metric(m, older[n])) if n in older else metric(m, n) for m in modules for n in INDEXED[m]}
    if "perception" in modules:
        quiet = F.coalesce(metric("perception", "silence_pct"), F.lit(0.0)) >= ACTIVE_FROM
        for n in ("mean_momentum", "mean_pattern_lock"):
            cols[n] = F.when(quiet, F.coalesce(metric("perception", f"{n}_active"), cols[n])).otherwise(cols[n])
    if text is not None:
        cols |= {n: text(m, n) for m in modules for n in TEXTS.get(m, [])}
    return some.select("track", *[c.alias(n) for n, c in cols.items()])
