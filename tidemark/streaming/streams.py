"""Structured Streaming forms of the windowed and stateful operators; the windowed ones take batch tables too.

Batch normalises by a whole track's largest value; a stream can't, so silence is judged against a fixed reference.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import catalog as K
from ..operators.captions import overlap


def sliding(events: DataFrame, time: str, value: str, width: str, hop: str, late: str) -> DataFrame:
    """Mean and count of ``value`` per (track, centred half-open window); the centre is start + width / 2."""
    x = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy("track", F.window(time, width, hop).alias("w")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return x.select("track", _centre("w").alias("centre"), "mean", "n")


def momentum(beats: DataFrame, time: str, width: str, hop: str, late: str, least: int = 3) -> DataFrame:
    """Momentum of a stream of beats per (track, centred half-open window): what timeseries.momentum gives at the window's centre.

    The beats of a window are gathered and their intervals taken inside it; a window emits once the watermark passes.
    """
    seconds = F.unix_micros(time) / 1e6
    x = beats.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy("track", F.window(time, width, hop).alias("w")).agg(F.sort_array(F.collect_list(seconds)).alias("_t"))
    gaps = F.zip_with(F.slice("_t", 2, F.size("_t")), F.slice("_t", 1, F.greatest(F.size("_t") - 1, F.lit(0))), lambda b, a: b - a)
    mean = F.aggregate("_d", F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size("_d"), F.lit(0))
    spread = F.sqrt(F.aggregate("_d", F.lit(0.0), lambda s, v: s + (v - F.col("_m")) * (v - F.col("_m"))) / F.nullif(F.size("_d"), F.lit(0)))
    span = (F.unix_micros("w.end") - F.unix_micros("w.start")) / 1e6
    x = x.withColumn("_d", gaps).withColumn("_m", mean).withColumn("_s", spread)
    steady = F.greatest(F.lit(0.0), 1 - F.try_divide("_s", "_m")) * F.least(F.lit(1.0), F.size("_t") / F.greatest(F.lit(1.0), F.try_divide(span, F.col("_m"))))
    value = F.when((F.size("_t") >= least) & (F.col("_m") > 0), steady).otherwise(0.0)
    return x.select("track", _centre("w").alias("centre"), F.size("_t").cast("long").alias("n"), F.coalesce(value, F.lit(0.0)).alias("momentum"))


def direction(pitches: DataFrame, time: str, value: str, width: str, hop: str, late: str, least: int = 3) -> DataFrame:
    """Slope of ``value`` a second (least squares) per (track, centred half-open window); 0 below ``least`` rows."""
    x = pitches.where(F.col(value).isNotNull()).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    x = x.withColumn("_x", F.unix_micros(time) / 1e6).groupBy("track", F.window(time, width, hop).alias("w"))
    x = x.agg(F.count("*").alias("n"), F.regr_slope(value, "_x").alias("_s"))
    return x.select("track", _centre("w").alias("centre"), F.when(F.col("n") >= least, F.coalesce("_s", F.lit(0.0))).otherwise(0.0).alias("direction"))


def _centre(w: str):
    return F.timestamp_micros(((F.unix_micros(f"{w}.start") + F.unix_micros(f"{w}.end")) / 2).cast("long"))


def tumbling(events: DataFrame, time: str, value: str, width: str, late: str) -> DataFrame:
    """Mean and largest ``value`` per (track, window)."""
    x = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return x.groupBy("track", F.window(time, width)).agg(F.avg(value).alias("mean"), F.max(value).alias("peak")).select("track", F.col("window.start").alias("start"), "mean", "peak")


def sessions(events: DataFrame, time: str, gap: str, late: str) -> DataFrame:
    """Clusters of events at most ``gap`` apart."""
    x = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return x.groupBy("track", F.session_window(time, gap)).agg(F.count("*").alias("n")).select("track", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _sorted(rows: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    parts = list(rows)
    return pd.concat(parts).sort_values(by, kind="stable") if parts else pd.DataFrame()


class SilenceRuns(StatefulProcessor):
    """Runs of ``db`` below a bound: one row when a run of at least ``least`` seconds ends."""

    below, least = -40.0, 0.5

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "start double, depth double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, depth = self.run.get() if self.run.exists() else (None, None)
        out = []
        for r in _sorted(rows, "t").itertuples():
            if r.db < self.below:
                start, depth = (r.t, r.db) if start is None else (start, min(depth, r.db))
            elif start is not None:
                if r.t - start >= self.least:
                    out.append((key[0], start, r.t, r.t - start, depth))
                start = depth = None
        if start is None:
            self.run.clear()
        else:
            self.run.update((float(start), float(depth)))
        yield pd.DataFrame(out, columns=["track", "start", "end", "duration", "depth_db"])

    def close(self) -> None:
        pass


class EdgeFlags(StatefulProcessor):
    """The five flags of events.edge_flags, the first that holds, with the sample before carried across batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prev = handle.getValueState("prev", "m double, b double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        m0, b0 = self.prev.get() if self.prev.exists() else (None, None)
        out = []
        for r in _sorted(rows, "t").itertuples():
            flags = (
                ("listener_locked", r.momentum > 0.8 and (m0 is None or m0 <= 0.8)),
                ("listener_floating", r.momentum < 0.2 and m0 is not None and m0 >= 0.2),
                ("pattern_break", r.disruption > 0.5),
                ("building", r.breath > 0.3 and b0 is not None and b0 <= 0.3),
                ("releasing", r.breath < -0.3 and b0 is not None and b0 >= -0.3),
            )
            out += [(key[0], r.t, name) for name, holds in flags if holds][:1]
            m0, b0 = float(r.momentum), float(r.breath)
        if m0 is not None:
            self.prev.update((m0, b0))
        yield pd.DataFrame(out, columns=["track", "t", "event"])

    def close(self) -> None:
        pass


class RollingCaptions(StatefulProcessor):
    """The new words of each caption segment past its overlap with what came before.

    State is the last ``reach`` words: an overlap is no longer than a segment, so that is the longest segment in words.
    """

    reach = 256

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.words = handle.getValueState("words", "w array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = list(self.words.get()[0]) if self.words.exists() else []
        out = []
        for r in _sorted(rows, "seg").itertuples():
            new = (r.text or "").split()
            novel = new[overlap(seen, new) :]
            if novel:
                out.append((key[0], r.seg, " ".join(novel)))
                seen = (seen + novel)[-self.reach :]
        if seen:
            self.words.update((seen,))
        yield pd.DataFrame(out, columns=["track", "seg", "text"])

    def close(self) -> None:
        pass


class _Held:
    """A value state in memory."""

    value = None

    def exists(self) -> bool:
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value) -> None:
        self.value = value

    def clear(self) -> None:
        self.value = None


class _InMemory:
    """What a processor needs of its handle, for one key of a batch table."""

    def getValueState(self, name: str, schema: str) -> _Held:
        return _Held()


def _stateful(df: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    """The processor's rows, its state kept by track: across batches of a stream, within one pass over a batch table."""
    if df.isStreaming:
        return df.groupBy("track").transformWithStateInPandas(processor, schema, "Append", "None")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        processor.init(_InMemory())
        return pd.concat(processor.handleInputRows(key, iter([pdf]), None))

    return df.groupBy("track").applyInPandas(run, schema)


def silence_runs(frames: DataFrame, below: float = -40.0, least: float = 0.5) -> DataFrame:
    """From a stream of (track, t, db); needs the RocksDB state store."""
    p = SilenceRuns()
    p.below, p.least = below, least
    return _stateful(frames, p, "track string, start double, end double, duration double, depth_db double")


def edge_flags(stream: DataFrame) -> DataFrame:
    """From a stream of (track, t, momentum, disruption, breath)."""
    return _stateful(stream, EdgeFlags(), "track string, t double, event string")


def rolling_captions(captions: DataFrame, reach: int = 256) -> DataFrame:
    """From a stream of (track, seg, text); ``reach`` is the longest segment in words."""
    p = RollingCaptions()
    p.reach = reach
    return _stateful(captions, p, "track string, seg long, text string")


def catalog_sink(rows: DataFrame, path: str, checkpoint: str):
    """A started query that merges each batch of catalog rows by track.

    Batch n makes version n from the newest one before it, so a batch done twice gives the same and a lost one shows in
    the version's number; two versions stay (see catalog.save). A batch rewrites the table: for large catalogs let
    batches be few, or use a table format with a merge.
    """

    def merge(batch: DataFrame, number: int) -> None:
        old = K.load(batch.sparkSession, path, below=number)
        if old is None and number and K.load(batch.sparkSession, path) is None:
            raise RuntimeError(f"batch {number}: no version before it in {path}")
        K.save(K.upsert(old, batch.dropDuplicates(["track"])), path, number)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
