"""Generic operators on ordered series: grids, band aggregates, as-of and interpolating joins, smoothing, islands.

Series are DataFrames with a ``track`` column; every operator works per track and shuffles by it at most once per
side. Interval joins are written as equi-joins by expanding a row to the grid points whose window holds it. Ordered
windows hold one track in a task: a track's rows grow with its length (a few thousand for a piece of music), not with
the number of tracks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_track(*order: str):
    return Window.partitionBy("track").orderBy(*order)


def grid(durations: DataFrame, hop: float) -> DataFrame:
    """(track, i, t) for t = i * hop below each track's ``duration``."""
    last = F.ceil(F.col("duration") / hop) - 1
    return durations.where("duration > 0").select("track", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i")).withColumn("t", F.col("i") * hop)


def in_windows(df: DataFrame, before: float, after: float, hop: float, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Rows repeated for every grid index i with t_i - before <= t < t_i + after (for spans: first and last both inside)."""
    first, last = first if first is not None else F.col("t"), last if last is not None else F.col("t")
    low = F.floor((last - after) / hop) + 1
    high = F.floor((first + before) / hop)
    return df.withColumn("_low", F.greatest(low, F.lit(0))).withColumn("_high", high).where("_low <= _high").withColumn("i", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")


def intervals(beats: DataFrame) -> DataFrame:
    """(track, t0, t, d): consecutive beats and their distance."""
    return beats.select("track", "t", F.lag("t").over(by_track("t")).alias("t0")).where("t0 IS NOT NULL").withColumn("d", F.col("t") - F.col("t0"))


def regularity(beats: DataFrame) -> DataFrame:
    """max(0, 1 - cv) of each track's beat intervals; 0 with at most one beat."""
    d = intervals(beats).groupBy("track").agg(F.avg("d").alias("m"), F.stddev_pop("d").alias("s"))
    value = F.coalesce(F.greatest(F.lit(0.0), 1 - F.try_divide("s", "m")), F.lit(0.0))
    return beats.select("track").distinct().join(d, "track", "left").select("track", value.alias("beat_regularity"))


def momentum(beats: DataFrame, points: DataFrame, width: float = 8.0, hop: float = 0.5, least: int = 3) -> DataFrame:
    """Per grid point: beats n in the half-open centred window and momentum, from the intervals inside the window.

    momentum = max(0, 1 - cv) * min(1, n / max(1, width / mean interval)); 0 below ``least`` beats.
    """
    inside = in_windows(intervals(beats), width / 2, width / 2, hop, F.col("t0"), F.col("t"))
    agg = inside.groupBy("track", "i").agg((F.count("*") + 1).alias("n"), F.avg("d").alias("m"), F.stddev_pop("d").alias("s"))
    steady = F.greatest(F.lit(0.0), 1 - F.try_divide("s", "m")) * F.least(F.lit(1.0), F.col("n") / F.greatest(F.lit(1.0), F.try_divide(F.lit(width), F.col("m"))))
    value = F.when((F.col("n") >= least) & (F.col("m") > 0), steady).otherwise(0.0)
    return points.join(agg, ["track", "i"], "left").select("track", "i", "t", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(value, F.lit(0.0)).alias("momentum"))


def window_average(rows: DataFrame, points: DataFrame, value: str, width: float, hop: float) -> DataFrame:
    """Mean of ``value`` in the half-open centred window of every grid point; 0 where it is empty."""
    agg = in_windows(rows, width / 2, width / 2, hop).groupBy("track", "i").agg(F.avg(value).alias("_v"))
    return points.join(agg, ["track", "i"], "left").select("track", "i", "t", F.coalesce("_v", F.lit(0.0)).alias(value))


def neighbours(points: DataFrame, rows: DataFrame, values: list[str], strict: bool = False, ahead: bool = True) -> DataFrame:
    """``points`` (track, i, t) with the nearest rows as structs of time ``at`` and ``values``.

    ``_back`` is the latest row at or before t (``strict``: before), ``_ahead`` the first at or after. One union and one
    exchange; both windows grow from their own end, so a track costs a sort in each direction. A track is one task.
    """
    kinds = dict(rows.dtypes)
    row = F.struct(F.col("t").alias("at"), *values)
    none = F.lit(None).cast("struct<at:double," + ",".join(f"`{v}`:{kinds[v]}" for v in values) + ">")
    both = points.select("track", "t", F.lit(1).alias("_p"), "i", none.alias("_r")).unionByName(rows.select("track", F.col("t").cast("double").alias("t"), F.lit(0).alias("_p"), F.lit(None).cast("long").alias("i"), row.alias("_r")))
    here = F.desc("_p") if strict else F.asc("_p")  # a point among the rows of its time
    up = Window.partitionBy("track").orderBy("t", here).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("track").orderBy(F.desc("t"), "_p").rowsBetween(Window.unboundedPreceding, 0)
    found = {"_back": F.last("_r", ignorenulls=True).over(up)} | ({"_ahead": F.last("_r", ignorenulls=True).over(down)} if ahead else {})
    return both.withColumns(found).where("i IS NOT NULL").select("track", "i", "t", *found)


def asof(points: DataFrame, rows: DataFrame, value: str, strict: bool = False) -> DataFrame:
    """``points`` (track, i, t) with the latest row's ``value`` and time ``_at`` at or before t (``strict``: before)."""
    return neighbours(points, rows, [value], strict, ahead=False).select("track", "i", "t", F.col("_back.at").alias("_at"), F.col(f"_back.{value}").alias(value))


def interpolate(points: DataFrame, knots: DataFrame, value: str | list[str]) -> DataFrame:
    """Linear interpolation between knots, clamped at both ends; knots where any of the values is null are left out."""
    values = [value] if isinstance(value, str) else list(value)
    x = neighbours(points, knots.dropna(subset=values), values)
    share = F.try_divide(F.col("t") - F.col("_back.at"), F.col("_ahead.at") - F.col("_back.at"))
    line = lambda v: F.coalesce(F.col(f"_back.{v}") + (F.col(f"_ahead.{v}") - F.col(f"_back.{v}")) * share, F.col(f"_back.{v}"), F.col(f"_ahead.{v}")).alias(v)
    return x.select("track", "i", "t", *map(line, values))


def moving_average(frames: DataFrame, value: str | list[str], size: int, out: str | list[str]) -> DataFrame:
    """Uniform filter over contiguous ``frame`` numbers from 0: the window [-size//2, size - size//2 - 1], mirrored at the edges.

    Several values of one size share the mirrored rows and the window.
    """
    pairs = [(value, out)] if isinstance(value, str) else list(zip(value, out, strict=True))
    n = F.count("*").over(Window.partitionBy("track"))
    before, after = size // 2, size - size // 2 - 1
    turns = F.ceil(F.lit(size) / F.col("_n"))
    places = F.flatten(F.transform(F.sequence(-turns, turns), lambda k: F.array(F.col("frame") + 2 * F.col("_n") * k, 2 * F.col("_n") * k - 1 - F.col("frame"))))
    padded = frames.withColumn("_n", n).withColumn("_p", F.explode(F.filter(places, lambda p: (p >= -before) & (p < F.col("_n") + after))))
    w = Window.partitionBy("track").orderBy("_p").rowsBetween(-before, after)
    return padded.withColumns({o: F.avg(v).over(w) for v, o in pairs}).where("_p = frame").drop("_n", "_p")


def max_normalised(df: DataFrame, value: str) -> DataFrame:
    """``value`` divided by the track's largest when that is positive."""
    top = F.max(F.abs(value)).over(Window.partitionBy("track"))
    return df.withColumn(value, F.when(top > 0, F.col(value) / top).otherwise(F.col(value)))


def gradient(df: DataFrame, value: str, out: str) -> DataFrame:
    """Central difference, one-sided at the ends, 0 alone."""
    w = by_track("frame")
    ahead, back = F.lead(value).over(w), F.lag(value).over(w)
    g = F.when(ahead.isNotNull() & back.isNotNull(), (ahead - back) / 2).otherwise(F.coalesce(ahead - F.col(value), F.col(value) - back, F.lit(0.0)))
    return df.withColumn(out, g)


def disruption_of(frames: DataFrame, value: str, size: int = 20) -> DataFrame:
    """Rise of ``value`` above its own moving average, not below 0."""
    out = moving_average(frames, value, size, "_m")
    return out.withColumn(value, F.greatest(F.lit(0.0), F.col(value) - F.col("_m"))).drop("_m")


def spectral_disruption(frames: DataFrame, value: str, size: int = 20) -> DataFrame:
    """``value`` normalised by the track's largest, then its rise above its moving average."""
    return disruption_of(max_normalised(frames, value), value, size)


def energy_disruption(frames: DataFrame, value: str, out: str, size: int = 20) -> DataFrame:
    """Steps of ``value`` to the next frame (0 at the last) above their moving average, normalised by the largest."""
    step = F.coalesce(F.abs(F.lead(value).over(by_track("frame")) - F.col(value)), F.lit(0.0))
    return max_normalised(disruption_of(frames.withColumn(out, step), out, size), out)


def breath(frames: DataFrame, value: str, out: str = "breath", size: int = 40) -> DataFrame:
    """Gradient of the smoothed ``value``, normalised by its largest size."""
    return max_normalised(gradient(moving_average(frames, value, size, "_smooth"), "_smooth", out), out).drop("_smooth")


def decibels(frames: DataFrame, value: str, out: str = "db") -> DataFrame:
    """20 log10 against the track's largest, not below -80."""
    top = F.max(value).over(Window.partitionBy("track"))
    db = 20 * F.log10(F.greatest(F.col(value), F.lit(1e-5))) - 20 * F.log10(F.greatest(top, F.lit(1e-5)))
    return frames.withColumn(out, F.greatest(db, F.lit(-80.0)))


def silences(frames: DataFrame, below: float = -40.0, least: float = 0.5) -> DataFrame:
    """(track, start, end, duration, depth_db): runs of quiet frames (track, t, db) of at least ``least``; a run ends at the next loud frame or the last frame."""
    w = by_track("t")
    quiet = F.col("db") < below
    x = frames.withColumn("_q", quiet).withColumn("_turn", (F.coalesce(F.lag("_q").over(w), ~F.col("_q")) != F.col("_q")).cast("int"))
    x = x.withColumn("_run", F.sum("_turn").over(w)).withColumn("_next", F.lead("t").over(w))
    runs = x.where("_q").groupBy("track", "_run").agg(F.min("t").alias("start"), F.max(F.coalesce("_next", "t")).alias("end"), F.min("db").alias("depth_db"))
    return runs.where(F.col("end") - F.col("start") >= least).select(
        "track", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), F.round(F.col("end") - F.col("start"), 2).alias("duration"), F.round("depth_db", 1).alias("depth_db")
    )


def in_silence(points: DataFrame, quiet: DataFrame) -> DataFrame:
    """``points`` with the depth of the silence whose closed span holds t, the first by start; silences of a track don't overlap, so the latest start decides."""
    spans = quiet.select("track", F.col("start").alias("t"), F.struct("end", "depth_db").alias("s"))
    x = asof(points, spans, "s")
    inside = F.col("s.end") >= F.col("t")
    return x.select("track", "i", "t", F.coalesce(inside, F.lit(False)).alias("silence"), F.when(inside, F.col("s.depth_db")).alias("silence_depth_db"))


def clusters(events: DataFrame, gap: float = 2.0) -> DataFrame:
    """``events`` (track, t, ...) with ``cluster``: events at most ``gap`` after the one before share it."""
    w = by_track("t")
    return events.withColumn("_new", F.coalesce((F.col("t") - F.lag("t").over(w) > gap).cast("int"), F.lit(1))).withColumn("cluster", F.sum("_new").over(w)).drop("_new")


def beat_disruption(beats: DataFrame, points: DataFrame, hop: float = 0.5, lookback: float = 5.0, absence: float = 1.5) -> DataFrame:
    """How far the next beat misses the time that the recent ones announce, 0 to 1."""
    spans = in_windows(intervals(beats), lookback, 0.0, hop, F.col("t0"), F.col("t")).groupBy("track", "i").agg(F.avg("d").alias("e"))
    order = beats.select("track", "t", F.row_number().over(by_track("t")).alias("k"), F.count("*").over(Window.partitionBy("track")).alias("total"))
    near = neighbours(points, order, ["k", "total"], strict=True)
    x = near.select("track", "i", "t", F.col("_back.at").alias("prev"), F.coalesce("_back.k", F.lit(0)).alias("before"), F.col("_ahead.at").alias("next"), F.coalesce("_back.total", "_ahead.total").alias("total"))
    x = x.where("total IS NOT NULL").join(spans, ["track", "i"], "left")
    gap = F.col("t") - F.col("prev")
    missing = F.when((F.col("before") > 3) & (gap > absence), F.least(F.lit(1.0), gap / lookback)).otherwise(0.0)
    error = F.least(F.lit(1.0), F.abs(F.col("next") - F.col("prev") - F.col("e")) / F.col("e"))
    known = F.when(F.col("next") < F.col("t") + 2 * F.col("e"), error).otherwise(0.5)
    value = F.when(F.col("total") <= 2, 0.0).when(F.col("e").isNull(), missing).when(F.col("e") > 0, known).otherwise(0.0)
    return x.select("track", "i", "t", value.alias("disruption"))
