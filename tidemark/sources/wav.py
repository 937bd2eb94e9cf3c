"""PCM WAV files as rows, through Spark's binaryFile reader and the standard library's decoder.

Other containers need an external decoder and are not read: such files come back with an error text.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SR = 22_050
SCHEMA = "track string, sr int, y array<float>, error string"


def resample(x: np.ndarray, rate: int, sr: int, lobes: int = 24) -> np.ndarray:
    """``x`` at ``sr`` by windowed-sinc interpolation, band-limited to the lower of both rates; a table holds each phase's weights."""
    step = int(np.gcd(rate, sr))
    up, down = sr // step, rate // step
    band = min(1.0, sr / rate)
    half = int(np.ceil(lobes / band))
    at = np.arange(-half, half + 1)
    far = np.arange(up)[:, None] / up - at[None, :]  # of each phase from its samples
    table = band * np.sinc(band * far) * np.where(np.abs(far) <= half, 0.5 + 0.5 * np.cos(np.pi * far / half), 0)
    table /= table.sum(1, keepdims=True)
    wide = np.lib.stride_tricks.sliding_window_view(np.pad(x, half), 2 * half + 1)
    n = np.arange(int(len(x) * sr / rate))
    out = np.empty(len(n))
    for i in range(0, len(n), 65_536):
        place = n[i : i + 65_536] * down
        out[i : i + 65_536] = np.einsum("ij,ij->i", wide[place // up], table[place % up])
    return out


def decode(content: bytes, sr: int = SR) -> np.ndarray:
    """Mono samples at ``sr`` in [-1, 1]: channels averaged, resampled."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float64) / 128 - 1
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float64) / float(1 << 8 * width - 1)
    x = x[: len(x) // channels * channels].reshape(-1, channels).mean(1)
    return (resample(x, rate, sr) if rate != sr and len(x) else x).astype(np.float32)


def read_wav(spark: SparkSession, path: str, sr: int = SR) -> DataFrame:
    """(track, sr, y, error) for every file; track is the file's name without its ending."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    y, error = decode(bytes(content), sr), None
                except (wave.Error, EOFError, ValueError) as e:
                    y, error = np.zeros(0, np.float32), str(e) or "unreadable"
                yield pd.DataFrame({"track": [name.rsplit("/", 1)[-1].rsplit(".", 1)[0]], "sr": [sr], "y": [y], "error": [error]})

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInPandas(run, SCHEMA)


def split_null(signals: DataFrame, least: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(signals to analyse, rejects with rms, duration and reason): silent or unreadable tracks stop here."""
    energy = F.aggregate("y", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    x = signals.withColumn("rms", F.coalesce(F.sqrt(energy / F.nullif(F.size("y"), F.lit(0))), F.lit(0.0))).withColumn("duration", F.size("y") / F.col("sr"))
    bad = F.col("error").isNotNull() | (F.col("rms") < least)
    rejects = x.where(bad).select("track", F.lit(True).alias("null_signal"), "rms", "duration", F.coalesce("error", F.lit("no signal")).alias("reason"))
    return x.where(~bad).drop("rms", "error"), rejects
