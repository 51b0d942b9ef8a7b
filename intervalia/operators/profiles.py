"""Profiles of windows that overlap by half, weak tails of segments, the next quiet place, and batches whose broken tracks don't stop the others."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold
from .intervals import points_in
from .scans import SIZE, affine

#: How a window's figures make its dynamic density, and how that and its spread make its complexity. Fixed values.
DENSITY = {"level": 0.5, "spread": 0.3, "rises": 0.2}
BLEND = (0.7, 0.3)


def windows(frames: DataFrame, tracks: DataFrame, width: float) -> DataFrame:
    """track, window (from 0), start, end, level, spread and rises (a second) of the frames (track, t, idx, value) in windows of this width that begin every half of it before the track
    ends. A window's frames lie in [start, end), the last windows are as long as the track allows; one without frames has figures 0."""
    half = width / 2
    rise = (F.col("value") > F.lag("value").over(Window.partitionBy("track").orderBy("idx"))).cast("int")
    k = F.floor(F.col("t") / half)
    own = frames.withColumn("_rise", F.coalesce(rise, F.lit(0))).select("track", "value", "_rise", F.explode(F.array(k, k - 1)).alias("window")).where("window >= 0")
    figures = own.groupBy("track", "window").agg(F.avg("value").alias("level"), F.stddev_pop("value").alias("spread"), F.sum("_rise").alias("_n"))
    n = F.greatest(F.lit(0).cast("bigint"), F.ceil(F.col("duration") / half).cast("bigint") - 1)
    all_ = tracks.select("track", "duration", F.explode(F.sequence(F.lit(0).cast("bigint"), n)).alias("window"))
    x = all_.join(figures, ["track", "window"], "left").na.fill(0.0, ["level", "spread"]).na.fill(0, ["_n"])
    start = F.col("window") * half
    end = F.least(start + width, F.col("duration"))
    return x.select("track", "window", start.alias("start"), end.alias("end"), "level", "spread", F.when(end > start, F.col("_n") / (end - start)).otherwise(0.0).alias("rises"))


def profile(of: DataFrame, base: float, gain: float, size: int = SIZE) -> DataFrame:
    """windows with density (its figures scaled over the track's windows to 0..1, or 0 where they are all equal), complexity and threshold, base and gain times the complexity, smoothed
    in place: each window in turn moves by 0.3 towards the mean of itself and its neighbours, of which the one before has moved already. Tracks of under three windows stay as they are."""
    whole = Window.partitionBy("track")
    unit = lambda c: F.when(F.max(c).over(whole) > F.min(c).over(whole), (F.col(c) - F.min(c).over(whole)) / (F.max(c).over(whole) - F.min(c).over(whole))).otherwise(0.0)
    x = of.withColumns({f"_{c}": unit(c) for c in DENSITY}).withColumn("density", sum((F.col(f"_{c}") * w for c, w in DENSITY.items()), F.lit(0.0)))
    x = x.withColumn("complexity", F.col("_spread") * BLEND[0] + F.col("density") * BLEND[1]).withColumn("_x", F.col("complexity") * gain + base)
    w = Window.partitionBy("track").orderBy("window")
    n, right = F.count("*").over(whole), F.lead("_x").over(w)
    first, last = F.col("window") == 0, right.isNull()
    a = F.when((n < 3) | first, 0.0).when(last, 0.15).otherwise(0.1)
    b = F.when(n < 3, F.col("_x")).when(first, 0.85 * F.col("_x") + 0.15 * right).when(last, 0.85 * F.col("_x")).otherwise(0.8 * F.col("_x") + 0.1 * right)
    smooth = affine(x.select("track", "window", a.alias("a"), b.alias("b")), "window", size).withColumnRenamed("y", "threshold")
    return x.join(smooth, ["track", "window"]).drop("_x", *(f"_{c}" for c in DENSITY))


def window_at(points: DataFrame, profiled: DataFrame, default: float, width: float) -> DataFrame:
    """points (track, point, t) with the first window that holds t, ends included, and its threshold; default and no window where none does."""
    inside = points_in(points.select("track", "point", "t"), profiled.select("track", "window", "start", "end", "threshold"), width, strict=False)
    first = inside.groupBy("track", "point").agg(F.min_by(F.struct("window", "threshold"), "window").alias("_w"))
    return points.join(first, ["track", "point"], "left").select("track", "point", "t", F.col("_w.window").alias("window"), F.coalesce("_w.threshold", F.lit(default)).alias("threshold"))


def segment_peaks(segments: DataFrame, samples: DataFrame) -> DataFrame:
    """segments (track, seg, start, end) with rms and peak of samples (track, t, value) in [start, end); 0 where there are none. One sort of both sides, no join of ranges."""
    w = Window.partitionBy("track").orderBy("t", "_sample").rowsBetween(Window.unboundedPreceding, 0)
    marks = segments.select("track", F.col("start").alias("t"), F.lit(0).alias("_sample"), "seg", F.col("end").alias("_end"))
    both = marks.unionByName(samples.select("track", "t", F.lit(1).alias("_sample"), "value"), allowMissingColumns=True)
    held = both.withColumns({"seg": F.last("seg", True).over(w), "_end": F.last("_end", True).over(w)}).where("_sample = 1 and seg is not null and t < _end")
    figures = held.groupBy("track", "seg").agg(F.sqrt(F.avg(F.col("value") * F.col("value")) + 1e-12).alias("rms"), F.max(F.abs("value")).alias("peak"))
    return segments.join(figures, ["track", "seg"], "left").na.fill(0.0, ["rms", "peak"])


def absorb_weak_tails(segments: DataFrame, least: float, rms_ratio: float = 0.12, peak_ratio: float = 0.18) -> DataFrame:
    """track, seg, start, end, human and absorbed of segments (track, seg, start, end, human, rms, peak): a human one shorter than least whose rms and peak are at most these parts of the medians over
    the track's longer human segments joins the music that follows it. A track without such segments (with an rms and a peak above 0) stays as it is."""
    whole, w = Window.partitionBy("track"), Window.partitionBy("track").orderBy("seg")
    long = F.col("human") & (F.col("end") - F.col("start") >= least)
    middle = lambda c: F.percentile(F.when(long & (F.col(c) > 0), F.col(c)), F.lit(0.5)).over(whole)
    weak = F.col("human") & ~F.lead("human").over(w) & (F.col("end") - F.col("start") < least) & (F.col("rms") <= middle("rms") * rms_ratio) & (F.col("peak") <= middle("peak") * peak_ratio)
    x = segments.withColumn("absorbed", F.coalesce(weak, F.lit(False)))
    joined = x.groupBy("track", (F.col("seg") + F.col("absorbed").cast("int")).alias("_g"))
    out = joined.agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.bool_and("human") & ~F.bool_or("absorbed")).alias("human"), F.bool_or("absorbed").alias("absorbed"))
    return out.select("track", (F.row_number().over(Window.partitionBy("track").orderBy("_g")) - 1).cast("bigint").alias("seg"), "start", "end", "human", "absorbed")


def next_quiet(points: DataFrame, frames: DataFrame, hop: float, percent: float, guard_db: float) -> DataFrame:
    """points (track, point, t) with quiet: t if its frame is quiet, else the time of the first quiet frame behind it, else -1; t where the track has no such frame. frames: track, frame (from 0), db. Quiet is at most guard_db over
    the track's percentile, half as much again where that is over -30 dB. One sort of the frames, and a join by frame."""
    whole = Window.partitionBy("track")
    floor = F.percentile("db", F.lit(percent)).over(whole)
    ok: Column = F.col("db") <= F.col("_floor") + F.when(F.col("_floor") > -30, guard_db * 1.5).otherwise(guard_db)
    ahead = Window.partitionBy("track").orderBy("frame").rowsBetween(0, Window.unboundedFollowing)
    marked = frames.withColumn("_floor", floor).withColumn("_ok", ok).select("track", "frame", F.first(F.when(F.col("_ok"), F.col("frame")), True).over(ahead).alias("_next"), F.lit(True).alias("_there"))
    own = points.withColumn("frame", F.when(F.col("t") >= 0, F.floor(F.col("t") / hop).cast("bigint")))
    x = own.join(marked, ["track", "frame"], "left")
    return x.select("track", "point", "t", F.when(F.col("_there").isNull() | (F.col("_next") == F.col("frame")), F.col("t")).when(F.col("_next").isNull(), -1.0).otherwise(F.col("_next") * hop).alias("quiet"))


def each_track(rows: DataFrame, order: list, work: Callable[[dict[str, np.ndarray]], list], schema: str) -> DataFrame:
    """work over each track's rows in order, its columns (track first) and error: what work raised for the track, which doesn't stop the others, or null."""
    return fold(rows, ["track"], order, work, schema, error="error")
