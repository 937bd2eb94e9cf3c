"""Command line: listen, catalog, compare, frames, assemble, doctor.

listen writes Parquet tables under --out: <module>_summary, <module>_stream, events, rejects and the catalog; and the
documents <module>.json (summaries) and <module>_stream.json, which sources.analysis reads.
"""

from __future__ import annotations

import argparse
import importlib.util
import sys
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import divergence_marker, format_time, valid_slug
from .operators import catalog as K
from .operators import events as E
from .plans import modules as M
from .plans import prompt as P
from .session import build_session
from .sources import analysis as A
from .sources.wav import read_wav, split_null

MODULES = ("report", "perception", "harmony", "melody", "overtone")


def read(spark: SparkSession, out: str, name: str) -> DataFrame | None:
    return K.load(spark, f"{out}/{name}")


def listen(spark: SparkSession, path: str, out: str, only: list[str] | None = None, skip: list[str] | None = None, index: bool = True) -> DataFrame:
    """Analyse every WAV file of ``path``; returns the rejects."""
    good, rejects = split_null(read_wav(spark, path))
    rejects.write.mode("overwrite").parquet(f"{out}/rejects")
    summaries = []
    for name, tables in M.analyse(good, only, skip).items():
        if len(tables) > 1:
            tables[0].write.mode("overwrite").parquet(f"{out}/{name}_stream")
            stream = spark.read.parquet(f"{out}/{name}_stream").drop("i")
            A.write_module(A.as_stream(stream.select("t", *[c for c, k in stream.dtypes if c != "t" and not k.startswith("map")])), out, f"{name}_stream", pretty=False)
        if len(tables) == 3:
            tables[1].write.mode("overwrite").parquet(f"{out}/events")
        tables[-1].write.mode("overwrite").parquet(f"{out}/{name}_summary")
        summary = spark.read.parquet(f"{out}/{name}_summary")
        A.write_module(_with_events(summary, out) if name == "perception" else summary, out, name)
        summaries.append((name, summary))
    if index and summaries:
        first = dict(summaries)
        texts = [t for names in K.TEXTS.values() for t in names]
        flat = lambda df: df.select("track", *[c for c, t in df.dtypes if c != "track" and (t in ("double", "bigint", "int") or c in texts)])
        base = flat(first["perception"]) if "perception" in first else flat(summaries[0][1]).select("track")
        others = [flat(df).drop(*[c for c in base.columns if c != "track"]) for n, df in summaries if n != "perception"]
        seen: set[str] = set(base.columns)
        for i, df in enumerate(others):
            others[i] = df.drop(*[c for c in df.columns if c != "track" and c in seen])
            seen |= set(others[i].columns)
        new = K.index_metrics(base, others)
        K.save(K.upsert(read(spark, out, "catalog"), new), f"{out}/catalog")
    return spark.read.parquet(f"{out}/rejects")


def _with_events(summary: DataFrame, out: str) -> DataFrame:
    """The perception summary with its events, as its document holds them."""
    events = summary.sparkSession.read.parquet(f"{out}/events")
    listed = events.groupBy("track").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.struct(*[c for c in events.columns if c not in ("track", "seq")]).alias("e")))), lambda s: s.e).alias("pattern_breaks"))
    return summary.join(listed, "track", "left")


def values(spark: SparkSession, out: str) -> DataFrame:
    tables = {m: t for m in MODULES if (t := read(spark, out, f"{m}_summary")) is not None}
    if not tables:
        raise SystemExit(f"no analysis in {out}")
    return K.flatten(tables)


def compare(spark: SparkSession, out: str, a: str, b: str) -> DataFrame:
    known = values(spark, out)
    if missing := sorted({a, b} - {r["track"] for r in known.where(F.col("track").isin(a, b)).select("track").distinct().collect()}):
        raise ValueError(f"no analysis of {', '.join(missing)}")
    x = K.compare(known, a, b)
    return x.withColumn("marker", divergence_marker(F.col("divergence"))).orderBy(F.desc_nulls_last("divergence"), "metric")


def hp_balance(h: Column, p: Column) -> Column:
    """A whole track's balance, null without energy."""
    return (p - h) / F.nullif(p + h, F.lit(0.0))


def assemble(spark: SparkSession, out: str, track: str, mode: str = "full", contexts: str | None = None, template: str = "none", docs: str | None = None) -> str:
    """The text packet of one track."""
    tables = [t.where(F.col("track") == track) for m in MODULES if (t := read(spark, out, f"{m}_summary")) is not None]
    context = A.load_context(spark, contexts or out, track).first()
    if not tables and context is None:
        raise ValueError(f"nothing is known of {track!r}")
    text = A.resolve_template(template, docs)
    drop: set[str] = {"track"}
    parts = []
    for t in tables:
        parts.append(t.drop(*[c for c in t.columns if c in drop and c != "track"]))
        drop |= set(t.columns)
    base = spark.createDataFrame([(track,)], "track string")
    row = reduce(lambda x, y: x.join(y, "track", "left"), parts, base)
    if {"harmonic_energy", "percussive_energy"} <= set(row.columns):
        row = row.withColumn("hp_balance", hp_balance(F.col("harmonic_energy"), F.col("percussive_energy")))
    events = read(spark, out, "events")
    if events is not None:
        listed = events.where(F.col("track") == track).groupBy("track").agg(F.collect_list(F.struct("time", "type", "intensity", "duration", "depth_db", "from", "to")).alias("_e"))
        row = row.join(listed, "track", "left").withColumn("_events", P.event_lines(F.col("_e")))
    row = row.join(A.load_context(spark, contexts or out, track), "track", "left")
    text_of = lambda name: F.try_variant_get("context", f"$.{name}", "string")
    full = F.concat_ws("\n\n", P.metrics({c: F.col(c) for c in row.columns}), *([F.col("_events")] if "_events" in row.columns else []))
    row = row.withColumn("_metrics", full).withColumn("_header", P.header(text_of("artist"), text_of("title"), F.coalesce(text_of("youtube_url"), text_of("source_url"))))
    row = row.withColumn("_background", P.background(P.context_text(text_of("artist_context")), P.context_text(text_of("song_context"))))
    captions = F.try_variant_get("context", "$.lyrics.caption_lines", "array<struct<ts:string,text:string>>")
    plain = F.coalesce(F.try_variant_get("context", "$.lyrics.full_text", "string"), F.when(~F.coalesce(text_of("lyrics"), F.lit("")).startswith("{"), text_of("lyrics")))
    row = row.withColumn("_lyrics", P.lyrics_section(F.try_variant_get("context", "$.lyrics.genius_text", "string"), captions, plain))
    frames = F.try_variant_get("context", "$.frame_descriptions", "array<struct<time:double,kind:string,type:string,intensity:double,description:string>>")
    row = row.withColumn("_frames", P.frames_section(frames))
    return row.select(P.packet(mode, text, background="_background", header="_header", metrics="_metrics", lyrics="_lyrics", frames="_frames")).first()[0]


def frames(spark: SparkSession, out: str, target: int, ratio: float) -> DataFrame:
    plan = M.visual_plan(spark.read.parquet(f"{out}/events"), read(spark, out, "report_summary"), read(spark, out, "perception_summary"), target, ratio)
    return plan.withColumn("at", format_time(F.col("time"))).orderBy("track", "time")


def moments(spark: SparkSession, out: str, target: int = 12, ratio: float = 0.6, descriptions: DataFrame | None = None) -> DataFrame:
    """What is to be described of every track: anchors of one event as one row, coverage times alone (the plan of frames()).

    With ``descriptions`` (track, place, description) the described moments go into the tracks' contexts.
    """
    groups = E.description_groups(frames(spark, out, target, ratio))
    if descriptions is None:
        return groups
    anchor = F.col("group").isNotNull()
    x = groups.join(descriptions.select("track", "place", "description"), ["track", "place"]).select(
        "track", F.coalesce("event_time", "time").alias("time"), F.when(anchor, "anchor").otherwise("coverage").alias("kind"), F.when(anchor, "anchor").otherwise("coverage").alias("role"), F.col("event_type").alias("event"),
        F.col("frames.time").alias("window"), F.col("frames.role").alias("roles"), "description",
    )
    contexts = A.load_context(spark, out).select("track", F.to_json("context").alias("context"))
    A.write_contexts(A.with_descriptions(contexts, x), out)
    return groups


def doctor() -> dict[str, bool]:
    return {name: importlib.util.find_spec(name) is not None for name in ("pyspark", "pyarrow", "pandas", "numpy")}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("tidemark")
    sub = p.add_subparsers(dest="verb", required=True)
    verb = {v: sub.add_parser(v) for v in ("listen", "catalog", "compare", "frames", "assemble", "doctor")}
    for v, q in verb.items():
        if v != "doctor":
            q.add_argument("--out", default="analysis")
    verb["listen"].add_argument("path")
    for flag in ("--only", "--skip"):
        verb["listen"].add_argument(flag, nargs="*", choices=MODULES)
    verb["listen"].add_argument("--no-catalog", action="store_true")
    verb["catalog"].add_argument("track", nargs="?")
    verb["compare"].add_argument("tracks", nargs=2)
    verb["frames"].add_argument("--target", type=int, default=12)
    verb["frames"].add_argument("--ratio", type=float, default=0.6)
    verb["assemble"].add_argument("track")
    verb["assemble"].add_argument("--mode", choices=list(P.MODES), default="full")
    verb["assemble"].add_argument("--template", default="none")
    a = p.parse_args(argv)
    if a.verb == "doctor":
        found = doctor()
        print("\n".join(f"{k}: {'found' if v else 'missing'}" for k, v in found.items()))
        return int(not all(found.values()))
    spark = build_session()
    if a.verb == "assemble" and not spark.range(1).select(valid_slug(F.lit(a.track))).first()[0]:
        p.error(f"invalid track name {a.track!r}")
    if a.verb == "listen":
        rejects = listen(spark, a.path, a.out, a.only, a.skip, not a.no_catalog).collect()
        print("\n".join(f"{r.track}: {r.reason} ({r.duration:.1f} s)" for r in rejects))
    elif a.verb == "catalog":
        v = K.long_form(read(spark, a.out, "catalog"))
        if a.track:
            card = K.summary_cards(v).where(F.col("track") == a.track).first()
            print(card["card"] if card else f"{a.track!r} is not in the catalog")
        else:
            K.stats(v).orderBy("metric").show(200, False)
    elif a.verb == "compare":
        compare(spark, a.out, *a.tracks).show(200, False)
    elif a.verb == "frames":
        frames(spark, a.out, a.target, a.ratio).show(1000, False)
    else:
        print(assemble(spark, a.out, a.track, a.mode, template=a.template))
    return 0


if __name__ == "__main__":
    sys.exit(main())
