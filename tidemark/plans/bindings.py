"""The driver's tables read as listener data.

events: a track per event_type, a beat per row, one second of music standing for an hour; frames are hours.
embeddings: a track per label, a frame per vector in order of vec_id; chroma folds |e_j| of j < 60 by j mod 12, the
spectrum is |e_j|. lineitem by supplier: a catalog of tracks and metrics. conversations: captions. listeners() and players() give whole feature tables, as the audio kernels would.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators import listening as L
from ..session import table


FRAME = 0.4712389  # seconds of a listener's frame, so that frames and grid points don't coincide


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("track"), (micros / 3.6e9).alias("t"), "value")


def durations(beats: DataFrame) -> DataFrame:
    return beats.groupBy("track").agg(F.max("t").alias("duration"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, frame, t, rms) for every hour from 0 to a track's last; hours without rows are silent."""
    x = hours(spark, sf_dir).groupBy("track", F.floor("t").alias("frame")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    every = x.groupBy("track").agg(F.max("frame").alias("m")).select("track", F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("frame"))
    return every.join(x, ["track", "frame"], "left").select("track", "frame", F.col("frame").cast("double").alias("t"), F.coalesce("rms", F.lit(0.0)).alias("rms"))


def vectors(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(track, frame, t, spec, more columns): absolute vectors of each label in order of vec_id."""
    w = Window.partitionBy("label").orderBy("vec_id")
    x = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("track"), (F.row_number().over(w) - 1).cast("long").alias("frame"), F.transform("embedding", lambda e: F.abs(e).cast("double")).alias("spec"), *more)
    return x.withColumn("t", F.col("frame") * 0.25)


def chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.array(*[sum((F.col("spec")[p + 12 * k] for k in range(1, 5)), F.col("spec")[p]) for p in range(12)])
    return vectors(spark, sf_dir).select("track", "frame", "t", fold.alias("chroma"))


def pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, t, f0, midi, prob): a pitch from each row's value, unvoiced (null) where the value is small."""
    f0 = F.when(F.col("value") >= 20, 55 + 2 * F.col("value"))
    return hours(spark, sf_dir).select("track", "t", f0.alias("f0"), (12 * F.log2(f0 / 440.0) + 69).alias("midi"), F.least(F.lit(1.0), F.col("value") / 100).alias("prob"))


def _placed(spark: SparkSession, sf_dir: str, name: str, *columns: Column | str) -> tuple[DataFrame, list[str]]:
    """``columns`` of table ``name`` and the names of those that say where a row stands in it (files by name)."""
    x = table(spark, sf_dir, name)
    place = {"_row": F.col("_metadata.row_index")}
    if len(x.inputFiles()) > 1:
        place = {"_file": F.col("_metadata.file_path")} | place
    return x.select(*columns, *[c.alias(n) for n, c in place.items()]), list(place)


def in_order(spark: SparkSession, sf_dir: str, name: str, track: Column, *columns: str) -> DataFrame:
    """``columns`` of table ``name`` with a track's rows together and in the table's order.

    groupBy("track") then adds doubles in that order, as the SQL on one thread does, wherever the rows lay. Means that
    lie halfway between two decimals are rounded by the last bit of such a sum. Rows stream through a sort: a track of
    any length needs no more memory, but is one task.
    """
    x, place = _placed(spark, sf_dir, name, track.alias("track"), *columns)
    return x.repartition("track").sortWithinPartitions("track", *place)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = in_order(spark, sf_dir, "lineitem", F.col("l_suppkey"), "l_quantity", "l_extendedprice", "l_discount")
    return x.groupBy("track").agg(
        F.round(F.avg("l_quantity"), 6).alias("mean_quantity"), F.round(F.avg("l_extendedprice"), 6).alias("mean_price"), F.round(F.avg("l_discount"), 6).alias("mean_discount"),
        F.max("l_quantity").alias("max_quantity"), F.count("*").cast("double").alias("lines"),
    )


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("track"), F.col("turn").alias("seg"), (F.col("turn") * 4.0).alias("start"), "text", "role")


def _in_frames(rows: DataFrame, length: float, **sums) -> DataFrame:
    """(track, frame, ...) aggregates of (track, t, value) rows for every frame from 0 to a track's last."""
    x = rows.groupBy("track", F.floor(F.col("t") / length).alias("frame")).agg(*[c.alias(n) for n, c in sums.items()])
    every = x.groupBy("track").agg(F.max("frame").alias("m")).select("track", F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("frame"))
    return every.join(x, ["track", "frame"], "left")


def _arrays(frames: DataFrame, **columns) -> DataFrame:
    """(track, one array a column in order of frame)."""
    rows = F.sort_array(F.collect_list(F.struct("frame", *[c.alias(n) for n, c in columns.items()])))
    return frames.groupBy("track").agg(rows.alias("_r")).select("track", *[F.col(f"_r.{n}").alias(n) for n in columns])


#: Columns of listeners() and their types, and ``classes`` and ``untimed``, which listeners_once() has beside them.
LISTENED = {
    "track": "string", "duration": "double", "tempo": "double", "beats": "array<double>", "onsets": "array<double>", "rms": "array<double>", "fine_rms": "array<double>", "flux": "array<double>", "h_rms": "array<double>",
    "p_rms": "array<double>", "centroid": "double", "zcr": "double", "chroma": "array<array<double>>", "classes": "array<array<double>>", "untimed": "long", "f0": "array<double>", "voiced": "array<double>", "bounds": "array<double>",
}


def _listened(t: np.ndarray, v: np.ndarray, known: np.ndarray) -> dict:
    """Features of a track's rows in the table's order, in which sums are added as in the SQL; a time may lack (NaN); ``known``: where the value is not null."""
    mean = np.cumsum(v[known])[-1] / known.sum() if known.any() else None
    pc = np.fmod(np.floor(v), 12)
    pitched = known & (pc >= 0)
    classes = np.bincount(pc[pitched].astype(np.int64), v[pitched], 12)
    untimed = int(np.isnan(t).sum())
    t, v, known, pc = (x[~np.isnan(t)] for x in (t, v, known, pc))
    last = float(np.ceil(t.max())) if len(t) else None

    def root(frame, n, some):
        count = np.bincount(frame[some], minlength=n)
        return np.sqrt(np.bincount(frame[some], (v * v)[some], n) / np.maximum(count, 1)) / 997, count

    def frames(length):
        frame = np.floor(t / length).astype(np.int64)
        return frame, max(int(frame.max()) + 1, 0) if len(frame) else 0, known & (frame >= 0)

    frame, n, some = frames(FRAME)
    rms, count = root(frame, n, some)
    fine, fine_n, fine_some = frames(FRAME / 2)
    m = np.bincount(frame[some], v[some], n) / np.maximum(count, 1)
    e = np.zeros((n, 12))
    sung = some & (pc >= 0)
    np.add.at(e, (frame[sung], pc[sung].astype(np.int64)), v[sung])
    return {
        "duration": last, "untimed": untimed, "tempo": 60.0 * len(t) / last if last else None, "beats": np.sort(t), "onsets": np.sort(t[known & ~(v <= 50)]), "rms": rms, "fine_rms": root(fine, fine_n, fine_some)[0], "flux": np.abs(np.diff(rms)), "h_rms": root(frame, n, some & (v < 100))[0],
        "p_rms": root(frame, n, some & ~(v < 100))[0], "centroid": mean * 10 if mean is not None else None, "zcr": mean / 1000 if mean is not None else None, "chroma": list(e), "classes": [classes] if n else [], "f0": np.where((count > 0) & (m >= 20), 55 + 2 * m, np.nan),
        "voiced": np.minimum(1.0, m / 97.31415), "bounds": np.array([0.0, last / 3, 2 * (last / 3), last] if last is not None else []),
    }


def listeners_once(spark: SparkSession, sf_dir: str, only: list[str]) -> DataFrame:
    """Columns ``only`` of listeners(), for one reading: a user's rows meet once, as two arrays in the table's order, and become a track's arrays there. ``classes``: chroma of the whole track as one frame."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    rows, place = _placed(spark, sf_dir, "events", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("track"), (micros / 2.16e10).alias("t"), "value")
    tracks = rows.where("track IS NOT NULL").groupBy("track").agg(F.sort_array(F.collect_list(F.struct(*place, "t", "value"))).alias("r")).select("track", "r.t", "r.value")
    kinds = StructType.fromDDL(", ".join(f"{c} {LISTENED[c]}" for c in only))
    schema = to_arrow_schema(kinds)

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, L.SLICE):
                tracks = range(start, min(start + L.SLICE, b.num_rows))
                yield L.batch([_listened(L.numbers(b.column(1), i), L.numbers(b.column(2), i), b.column(2)[i].values.is_valid().to_numpy(zero_copy_only=False)) | {"track": b.column(0)[i].as_py()} for i in tracks], schema)

    return tracks.mapInArrow(run, kinds)


def listeners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a track per user: a beat per event, one second for six hours; kept, as the analyses explode them."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("track"), (micros / 2.16e10).alias("t"), "value")
    root = lambda c: F.coalesce(F.sqrt(F.avg(c * c)), F.lit(0.0)) / 997
    v = F.col("value")
    classes = [F.coalesce(F.sum(F.when(F.floor(v) % 12 == k, v)), F.lit(0.0)).alias(str(k)) for k in range(12)]
    frames = _in_frames(rows, FRAME, rms=root(v), h=root(F.when(v < 100, v)), p=root(F.when(v >= 100, v)), m=F.avg("value"), c=F.array(*classes))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    f0 = F.when(F.col("m") >= 20, 55 + 2 * F.col("m"))
    none = F.array(*[F.lit(0.0)] * 12)
    x = _arrays(frames, rms=zero(F.col("rms")), h_rms=zero(F.col("h")), p_rms=zero(F.col("p")), chroma=F.coalesce("c", none), f0=f0, voiced=F.least(F.lit(1.0), zero(F.col("m")) / 97.31415))
    fine = _arrays(_in_frames(rows, FRAME / 2, rms=root(v)), fine_rms=zero(F.col("rms")))
    own = rows.groupBy("track").agg(F.ceil(F.max("t")).cast("double").alias("duration"), F.sort_array(F.collect_list("t")).alias("beats"), F.sort_array(F.collect_list(F.when(v > 50, F.col("t")))).alias("onsets"), (F.avg("value") * 10).alias("centroid"), (F.avg("value") / 1000).alias("zcr"))
    third = F.col("duration") / 3
    return own.join(x, "track").join(fine, "track").withColumns({
        "tempo": 60.0 * F.size("beats") / F.col("duration"), "bounds": F.array(F.lit(0.0), third, 2 * third, F.col("duration")),
        "flux": F.zip_with(F.slice("rms", 2, F.size("rms")), F.slice("rms", 1, F.greatest(F.size("rms") - 1, F.lit(0))), lambda b, a: F.abs(b - a)),
    }).persist()


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a track per label: chroma, pitch and peaks of a vector per frame, a quarter of a second each."""
    f0 = F.when(F.col("vec_id") % 7 > 0, (80 + F.col("vec_id") % 40 * 5).cast("double"))
    x = vectors(spark, sf_dir, "vec_id").withColumn("f0", f0)
    fold = F.array(*[sum((F.col("spec")[p + 12 * k] for k in range(1, 5)), F.col("spec")[p]) for p in range(12)])
    peaks = F.transform("spec", lambda m, j: F.struct(((j + 1) * 40.0).alias("freq"), m.alias("mag")))
    out = _arrays(x.withColumn("track", F.concat(F.lit("l"), F.col("track").cast("string"))), chroma=fold, overtones=F.struct("frame", "f0", peaks.alias("peaks")))
    return out.withColumn("duration", F.size("chroma") * 0.25).persist()
