"""Overtone series of a frame's spectral peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_harmonics(frames: DataFrame, top: int = 30, most: int = 16, within_cents: float = 50.0) -> DataFrame:
    """Nearest-peak join of each frame's ideal harmonics (columns track, frame, f0, peaks array<struct<freq, mag>>), inside the row."""
    best = F.slice(F.sort_array(F.transform("peaks", lambda p: F.struct(p.mag.alias("mag"), p.freq.alias("freq"))), asc=False), 1, top)
    x = frames.withColumn("_p", best).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(most))))
    near = F.array_min(F.transform("_p", lambda p: F.struct(F.abs(1200 * F.log2(p.freq / (F.col("n") * F.col("f0")))).alias("cents"), p.freq.alias("freq"), p.mag.alias("mag"))))
    return x.withColumn("m", near).where(F.col("m.cents") <= within_cents).select("track", "frame", F.col("n").cast("long").alias("n"), F.col("m.mag").alias("magnitude"), F.col("m.cents").alias("cents"))
