"""Bars from beats: a grid, figures per bar, high bars, chorus regions, beat candidates and quiet windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold
from .intervals import nearest
from .series import greedy_gap, runs


def grid(beats: DataFrame, tracks: DataFrame, per_bar: int = 4) -> DataFrame:
    """track, bar, start, end: bars begin at every per_bar-th beat, the last one ends with the track. A track of fewer beats has a uniform
    grid by their mean distance, or of 2 seconds a bar, up to the first boundary at or behind its end."""
    n = F.row_number().over(Window.partitionBy("track").orderBy("a")) - 1
    own = beats.withColumn("_n", n)
    figures = own.groupBy("track").agg(F.count("*").alias("_beats"), ((F.max("a") - F.min("a")) / F.greatest(F.count("*") - 1, F.lit(1))).alias("_mean"))
    x = tracks.join(figures, "track", "left").na.fill({"_beats": 0})
    w = Window.partitionBy("track").orderBy("start")
    many = own.where(F.col("_n") % per_bar == 0).join(x.where(F.col("_beats") >= per_bar), "track").select("track", "duration", F.floor(F.col("_n") / per_bar).alias("bar"), F.col("a").alias("start"))
    many = many.select("track", "bar", "start", F.coalesce(F.lead("start").over(w), "duration").alias("end"))
    width = F.when(F.col("_beats") >= 2, F.col("_mean") * per_bar).otherwise(60.0 / 120.0 * per_bar)
    few = x.where(F.col("_beats") < per_bar).withColumn("_w", width).select("track", "_w", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil((F.col("duration") + F.col("_w")) / F.col("_w")).cast("bigint") - 2, F.lit(0)))).alias("bar"))
    return many.unionByName(few.select("track", "bar", (F.col("bar") * F.col("_w")).alias("start"), ((F.col("bar") + 1) * F.col("_w")).alias("end")))


def per_bar(bars: DataFrame, frames: DataFrame, columns: list[str]) -> DataFrame:
    """bars with the means of frames (track, t) in [start, end); 0 where a bar has none. One sort of both, no join."""
    w = Window.partitionBy("track").orderBy("t", "_frame").rowsBetween(Window.unboundedPreceding, 0)
    marks = bars.select("track", F.col("start").alias("t"), F.lit(0).alias("_frame"), "bar", F.col("end").alias("_end"))
    both = marks.unionByName(frames.select("track", "t", F.lit(1).alias("_frame"), *columns), allowMissingColumns=True)
    held = both.withColumns({"bar": F.last("bar", True).over(w), "_end": F.last("_end", True).over(w)}).where("_frame = 1 and bar is not null and t < _end")
    means = held.groupBy("track", "bar").agg(*(F.avg(c).alias(c) for c in columns))
    return bars.join(means, ["track", "bar"], "left").na.fill(0.0, columns)


def analysis(beats: DataFrame, bars: DataFrame, share: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Tempo of each track (60 over the mean distance of beats), and bars (energy) with threshold and high, energy at or over it."""
    tempo = beats.groupBy("track").agg(F.when(F.count("*") > 1, 60 * (F.count("*") - 1) / (F.max("a") - F.min("a"))).otherwise(0.0).alias("tempo"))
    threshold = F.percentile("energy", F.lit(share)).over(Window.partitionBy("track"))
    return tempo, bars.withColumn("threshold", threshold).withColumn("high", F.col("energy") >= F.col("threshold"))


def chorus(bars: DataFrame, least: int = 4) -> DataFrame:
    """bars with score and region: energy, centroid and bandwidth scaled to 0..1 and weighed by how much the energy varies; bars at or over
    P60 in rows of at least so many are a region (its number in the track), others have none."""
    whole = Window.partitionBy("track")
    unit = lambda c: F.when(F.max(c).over(whole) - F.min(c).over(whole) > 1e-6, (F.col(c) - F.min(c).over(whole)) / (F.max(c).over(whole) - F.min(c).over(whole))).otherwise(0.0)
    x = bars.withColumns({"_cv": F.stddev_pop("energy").over(whole) / (F.avg("energy").over(whole) + 1e-6), "_e": unit("energy"), "_c": unit("centroid"), "_b": unit("bandwidth")})
    pick = lambda low, mid, high: F.when(F.col("_cv") < 0.15, low).when(F.col("_cv") > 0.4, high).otherwise(mid)
    x = x.withColumn("score", F.col("_e") * pick(0.3, 0.5, 0.6) + F.col("_c") * pick(0.4, 0.25, 0.2) + F.col("_b") * pick(0.3, 0.25, 0.2))
    return regions(x.withColumn("_t", F.percentile("score", F.lit(0.6)).over(whole)), F.col("score") >= F.col("_t"), least).drop("_cv", "_e", "_c", "_b", "_t")


def regions(bars: DataFrame, high: Column, least: int) -> DataFrame:
    """bars with region: the number of the row of high bars, of at least least, that a bar belongs to, and place, its place in it."""
    run = Window.partitionBy("track", "run")
    x = runs(bars, high, order="bar").withColumns({"_n": F.count("*").over(run), "_p": F.row_number().over(run.orderBy("bar")) - 1})
    held = F.col("flag") & (F.col("_n") >= least)
    return x.withColumns({"region": F.when(held, F.col("run")), "place": F.when(held, F.col("_p"))}).drop("run", "_n", "_p", "flag")


def beat_candidates(regional: DataFrame, tracks: DataFrame, per_cut: int = 2, score: float = 0.3) -> DataFrame:
    """A weak candidate at every per_cut-th bar of each region, inside the track."""
    x = regional.where(f"region is not null and place % {max(1, per_cut)} = 0").join(tracks, "track").where("start > 0 and start < duration")
    return x.select("track", F.col("start").alias("t"), F.lit(score).alias("score"), F.lit("beat").alias("source"), "bar")


def bar_types(bars: DataFrame) -> DataFrame:
    whole = Window.partitionBy("track")
    p = lambda s: F.percentile("energy", F.lit(s)).over(whole)
    return bars.withColumn("kind", F.when(F.col("energy") >= p(0.8), "chorus_peak").when(F.col("energy") >= p(0.6), "chorus").otherwise("verse"))


def holding_bar(points: DataFrame, bars: DataFrame) -> DataFrame:
    """points (track, t) with the bar that holds them; points behind the last bar belong to it, those before the first to none."""
    names = [c for c in points.columns if c not in ("track", "t")]
    w = Window.partitionBy("track").orderBy("t", "_point").rowsBetween(Window.unboundedPreceding, 0)
    marks = bars.select("track", F.col("start").alias("t"), F.lit(0).alias("_point"), "bar")
    both = marks.unionByName(points.select("track", "t", F.lit(1).alias("_point"), *names), allowMissingColumns=True)
    return both.withColumn("bar", F.last("bar", True).over(w)).where("_point = 1").select("track", "t", *names, "bar")


def quiet(frames: DataFrame, db: Column, before: int, behind: int, guard: float) -> DataFrame:
    """frames with quiet: the mean level around, in dB, is at most guard over the track's P5."""
    near = Window.partitionBy("track").orderBy("idx").rowsBetween(-before, behind)
    return frames.withColumn("_db", db).withColumn("quiet", F.avg("_db").over(near) <= F.percentile("_db", F.lit(0.05)).over(Window.partitionBy("track")) + guard).drop("_db")


def converted(cuts: DataFrame, tracks: DataFrame, rate: int) -> DataFrame:
    """track, sample, flag: cuts (track, t, flag, n: order) once for each time with their first flag, both ends added, times cut off to samples."""
    first = cuts.groupBy("track", "t").agg(F.min_by("flag", "n").alias("flag"))
    ends = tracks.select("track", F.explode(F.array(F.lit(0.0), F.col("duration"))).alias("t"), F.lit(False).alias("flag"))
    x = first.where("t > 0").join(tracks, "track").where("t < duration").select("track", "t", "flag").unionByName(ends)
    return x.select("track", F.expr(f"cast(t * {rate} as bigint)").alias("sample"), "t", "flag").groupBy("track", "sample").agg(F.min_by("flag", "t").alias("flag"))


def uniform_split(tracks: DataFrame, low: float, high: float) -> DataFrame:
    """track, ord, t: equal parts of at most high; where these are under low, as many as low allows."""
    n = F.greatest(F.lit(1), F.ceil(F.col("duration") / high))
    n = F.when((F.col("duration") / n < low) & (n > 1), F.greatest(F.lit(1), F.floor(F.col("duration") / low))).otherwise(n).cast("bigint")
    x = tracks.where("duration > 0").withColumn("_n", n).select("track", "duration", "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n"))).alias("ord"))
    return x.select("track", "ord", F.when(F.col("ord") == F.col("_n"), F.col("duration")).otherwise(F.round(F.col("ord") * F.col("duration") / F.col("_n"), 9)).alias("t"))


def snapped_cuts(cuts: DataFrame, beats: DataFrame, bars: DataFrame, tolerance: float, least: float, dense: bool = False) -> DataFrame:
    """track, t, snapped: cuts (track, t) inside high bars (bars: track, bar, start, high) go to the nearest quiet beat (beats: track, a, quiet) within
    tolerance, but at most 0.4 of a track's mean beat; others stay. In order of the cuts, one less than least behind the last kept is
    dropped. With dense, the first quiet beat of each high bar is added if over half of least away from all that is there."""
    reach = beats.groupBy("track").agg(F.least(F.lit(tolerance), F.try_divide(0.4 * (F.max("a") - F.min("a")), F.count("*") - 1)).alias("_reach"))
    near = nearest(cuts.select("track", "t"), beats.where("quiet").select("track", "a"))
    held = holding_bar(near, bars).join(bars.select("track", "bar", "high"), ["track", "bar"], "left").join(reach, "track", "left")
    go = F.coalesce(F.col("high") & (F.col("distance") <= F.coalesce("_reach", F.lit(tolerance))), F.lit(False))
    rows = held.select("track", F.lit(0).alias("part"), "t", F.when(go, F.col("nearest_a")).otherwise(F.col("t")).alias("to"), go.alias("snapped"))
    if dense:
        in_bar = holding_bar(beats.select("track", F.col("a").alias("t"), "quiet"), bars).where("bar is not null").groupBy("track", "bar").agg(F.min(F.struct("t", "quiet")).alias("b"))
        first = in_bar.join(bars.where("high").select("track", "bar"), ["track", "bar"]).where("b.quiet")
        rows = rows.unionByName(first.select("track", F.lit(1).alias("part"), "b.t", F.col("b.t").alias("to"), F.lit(True).alias("snapped")))

    def step(x: dict[str, np.ndarray]) -> list:
        kept, flags = [0.0], [False]
        for part, to, snapped in zip(x["part"].tolist(), x["to"].tolist(), x["snapped"].tolist()):
            if to - kept[-1] >= least if part == 0 else min(abs(to - k) for k in kept) > 0.5 * least:
                kept.append(to)
                flags.append(snapped)
        order = np.argsort(kept[1:], kind="stable")
        return [np.full(len(order), x["track"][0]), np.array(kept[1:])[order], np.array(flags[1:], bool)[order]]

    return fold(rows, ["track"], ["part", "t"], step, "track bigint, t double, snapped boolean")


def inner_cuts(points: DataFrame, tracks: DataFrame, gap: float, margin: float) -> DataFrame:
    """points (track, t) over margin (at most half the track) from both ends, kept in order if at least gap behind the last kept."""
    edge = F.least(F.lit(margin), F.col("duration") / 2)
    return greedy_gap(points.join(tracks, "track").where((F.col("t") > edge) & (F.col("t") < F.col("duration") - edge)).select("track", "t"), gap)


def samples_at(points: DataFrame, rate: int, other: int, latency: float = 0.0) -> DataFrame:
    """points (track, t) with the sample that holds t, the nearest one, and that at another rate of what was heard latency later."""
    t = F.col("t")
    return points.withColumns({"inside": F.floor(t * rate).cast("bigint"), "nearest": F.rint(t * rate).cast("bigint"), "mapped": F.greatest(F.lit(0), F.rint((F.floor(t * rate) / rate - latency) * other).cast("bigint"))})
