"""Per-track JSON results, contexts, cue files and lyric pages as tables, and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.captions import parse_cues, parse_lyric_page

MODULES = ("report", "perception", "harmony", "melody", "overtone")


def _documents(spark: SparkSession, root: str, file: str, folder: str, track: str | None) -> DataFrame:
    """(track, doc variant) of the files <root>/<track>/<file> and of <root>/<folder>/track=<track>, which win; unreadable documents are null."""
    found = []
    written, single = f"{root}/{folder}/track={track or '*'}", f"{root}/{track or '*'}/{file}"
    reader = spark.read.schema("value string, track string").option("basePath", f"{root}/{folder}")
    for read, of in ((lambda: reader.text(written, wholetext=True), F.col("track")), (lambda: spark.read.text(single, wholetext=True).select("value", "_metadata.file_path"), F.element_at(F.split("file_path", "/"), -2))):
        try:
            files = read()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        found.append(files.select(of.alias("track"), F.try_parse_json("value").alias("doc")))
    if not found:
        return spark.createDataFrame([], "track string, doc string").select("track", F.try_parse_json("doc").alias("doc"))
    return found[0] if len(found) == 1 else found[1].join(found[0], "track", "left_anti").unionByName(found[0])


def read_module(spark: SparkSession, root: str, module: str, track: str | None = None) -> DataFrame:
    """(track, doc variant) of <root>/<track>/<track>_<module>.json and of what write_module() wrote; no file gives no rows."""
    return _documents(spark, root, f"*_{module}.json", f"{module}.json", track)


def load_analysis(spark: SparkSession, root: str, track: str | None = None) -> DataFrame:
    """(track, report, perception, harmony, melody, overtone) as variants; a module without a file is null."""
    out = None
    for m in MODULES:
        part = read_module(spark, root, m, track).withColumnRenamed("doc", m)
        out = part if out is None else out.join(part, "track", "full")
    return out


def load_context(spark: SparkSession, root: str, track: str | None = None) -> DataFrame:
    """(track, context variant) of <root>/<track>/context.json and of what write_contexts() wrote."""
    return _documents(spark, root, "context.json", "contexts.json", track).withColumnRenamed("doc", "context")


def write_contexts(contexts: DataFrame, root: str) -> None:
    """Context documents (track, context string) below <root>/contexts.json; those that are no JSON objects are not written, so that the original stays."""
    whole = contexts.where(F.coalesce(F.schema_of_variant(F.try_parse_json("context")).startswith("OBJECT"), F.lit(False)))
    whole.select("track", F.col("context").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("track").text(f"{root}/contexts.json")


def metric(doc: str, name: str):
    """A number in a module's variant, at the top or in its summary."""
    return F.coalesce(F.try_variant_get(doc, f"$.{name}", "double"), F.try_variant_get(doc, f"$.summary.{name}", "double"))


def text_field(doc: str, name: str):
    """A text in a module's variant, at the top or in its summary."""
    return F.coalesce(F.try_variant_get(doc, f"$.{name}", "string"), F.try_variant_get(doc, f"$.summary.{name}", "string"))


def read_cues(spark: SparkSession, path: str) -> DataFrame:
    """(track, seg, start, text) of WebVTT files; track is the file's name up to its first point."""
    name = F.element_at(F.split(F.element_at(F.split("_p", "/"), -1), r"\."), 1)
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("_p")).select(name.alias("track"), "value")
    return cues(files)


def cues(files: DataFrame) -> DataFrame:
    """(track, seg, start, text) of WebVTT texts (track, value)."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for track, value in zip(pdf["track"], pdf["value"], strict=True):
                cues = parse_cues(value)
                yield pd.DataFrame({"track": track, "seg": range(len(cues)), "start": [c[0] for c in cues], "text": [c[1] for c in cues]})

    return files.select("track", "value").mapInPandas(run, f"track {dict(files.dtypes)['track']}, seg long, start double, text string")


def lyric_pages(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, lines array, sections array) of lyric pages."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            got = [parse_lyric_page(p or "") for p in pdf["_h"]]
            yield pd.DataFrame({"k": pdf["_k"], "lines": [g[0] for g in got], "sections": [g[1] for g in got]})

    kind = dict(pages.dtypes)[key]
    return pages.select(F.col(key).alias("_k"), F.col(html).alias("_h")).mapInPandas(run, f"k {kind}, lines array<string>, sections array<string>").withColumnRenamed("k", key)


def write_module(df: DataFrame, root: str, module: str, pretty: bool = True) -> None:
    """One JSON document a row below <root>/<module>.json/track=<track>; other tracks' documents stay.

    Summaries are indented, streams (``pretty`` False) compact.
    """
    doc = F.to_json(F.struct(*df.columns), {"pretty": str(pretty).lower()})
    df.select("track", doc.alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("track").text(f"{root}/{module}.json")


def as_stream(rows: DataFrame, order: str = "t") -> DataFrame:
    """(track, stream): a track's rows as one array in order."""
    fields = [order, *[c for c in rows.columns if c not in ("track", order)]]
    return rows.groupBy("track").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("stream"))


def with_descriptions(contexts: DataFrame, descriptions: DataFrame) -> DataFrame:
    """contexts (track, context string) with frame_descriptions set from descriptions (track, time, ...); unreadable contexts stay as they are."""
    listed = descriptions.groupBy("track").agg(F.sort_array(F.collect_list(F.struct("time", *[c for c in descriptions.columns if c not in ("track", "time")]))).alias("_f"))
    fields = F.from_json("context", "map<string,variant>")  # the other fields stay as they are
    merged = F.to_json(F.map_concat(F.map_filter(fields, lambda k, v: k != "frame_descriptions"), F.create_map(F.lit("frame_descriptions"), F.parse_json(F.to_json("_f")))))
    return contexts.join(listed, "track", "left").select("track", F.when(F.col("_f").isNotNull() & fields.isNotNull(), merged).otherwise(F.col("context")).alias("context"))


def resolve_template(name: str, folder: str | None = None) -> str | None:
    """A prompt template's text: None for ``none``, a file's content for a path or a name in ``folder``; else ValueError."""
    from pathlib import Path

    if name == "none":
        return None
    for p in (Path(name), *([Path(folder) / f"{name}.md", Path(folder) / f"{name}.txt"] if folder else [])):
        if p.is_file():
            return p.read_text(encoding="utf-8")
    raise ValueError(f"unknown template {name!r}")
