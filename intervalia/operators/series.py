"""Ordered series (track, idx or t, value): runs, morphology, valleys, clusters, rolling figures, folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold


def runs(frames: DataFrame, flag: Column, keys: list[str] = ["track"], order: str = "idx") -> DataFrame:
    """frames with flag and run, which counts the maximal runs of equal flags."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = frames.withColumn("flag", flag)
    change = F.coalesce((F.col("flag") != F.lag("flag").over(w)).cast("int"), F.lit(1))
    return marked.withColumn("_change", change).withColumn("run", F.sum("_change").over(w)).drop("_change")


def flagged_spans(frames: DataFrame, flag: Column, least: int = 1) -> DataFrame:
    """track, start, end (t of first and last frame) and n of runs of true with at least so many frames."""
    return runs(frames, flag).where("flag").groupBy("track", "run").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n")).where(F.col("n") >= least).drop("run")


def morphology(frames: DataFrame, flag: Column, fill: int, drop: int) -> DataFrame:
    """Runs of false of at most fill frames become true, then runs of true of at most drop frames false."""
    size = Window.partitionBy("track", "run")
    filled = runs(frames, flag).withColumn("flag", F.col("flag") | (F.count("*").over(size) <= fill)).drop("run")
    return runs(filled, F.col("flag")).withColumn("flag", F.col("flag") & (F.count("*").over(size) > drop)).drop("run")


def valleys(frames: DataFrame, percent: float = 0.35) -> DataFrame:
    """Frames at or under the track's percentile that are lower than a neighbour."""
    w, whole = Window.partitionBy("track").orderBy("idx"), Window.partitionBy("track")
    x = frames.withColumns({"_p": F.percentile("value", F.lit(percent)).over(whole), "_l": F.lag("value").over(w), "_r": F.lead("value").over(w)})
    return x.where((F.col("value") <= F.col("_p")) & ((F.col("value") < F.col("_l")) | (F.col("value") < F.col("_r")))).drop("_p", "_l", "_r")


def clusters(points: DataFrame, tolerance: float, order: list[str], open_at: bool = False) -> DataFrame:
    """points with cluster: a new one where t is more than tolerance behind the point before (with open_at, tolerance or more)."""
    w = Window.partitionBy("track").orderBy("t", *order)
    step = F.col("t") - F.lag("t").over(w)
    opens = F.coalesce((step >= tolerance if open_at else step > tolerance).cast("int"), F.lit(1))
    return points.withColumn("_opens", opens).withColumn("cluster", F.sum("_opens").over(w)).drop("_opens")


def rolling_rms(frames: DataFrame, before: int, behind: int) -> DataFrame:
    w = Window.partitionBy("track").orderBy("idx").rowsBetween(-before, behind)
    return frames.withColumn("rms", F.sqrt(F.avg(F.col("value") * F.col("value")).over(w)))


def smoothed(frames: DataFrame, alpha: float) -> DataFrame:
    """track and the last value of y = alpha * y + (1 - alpha) * x from 0: a sum in which each frame weighs by how many follow it."""
    behind = F.max("idx").over(Window.partitionBy("track")) - F.col("idx")
    weighed = frames.withColumn("_w", (1 - alpha) * F.pow(F.lit(alpha), behind) * F.col("value"))
    return weighed.groupBy("track").agg(F.sum("_w").alias("smoothed"))


def greedy_gap(points: DataFrame, gap: float) -> DataFrame:
    """track and t of points kept in order if at least gap behind the last kept one. Points that far behind the one before begin a chain of their own."""

    def step(x: dict[str, np.ndarray]) -> list:
        t, kept, at = x["t"], [], 0
        while at < len(t):
            kept.append(at)
            at = max(at + 1, int(np.searchsorted(t, t[at] + gap)))
            while at < len(t) and t[at] - t[kept[-1]] < gap:  # where the sum was rounded
                at += 1
        return [x["track"][kept], t[kept]]

    chains = clusters(points.select("track", "t"), gap, [], open_at=True)
    return fold(chains, ["track", "cluster"], ["t"], step, "track bigint, t double")
