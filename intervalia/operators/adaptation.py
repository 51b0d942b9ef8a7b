"""Thresholds and weights that follow a track's tempo and dynamics; cut lists rewritten by minimum lengths."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import clamp
from .folds import fold

#: Tempos at which a profile holds alone. Fixed values.
ANCHORS = ((60.0, "ballad"), (110.0, "pop"), (140.0, "rap"), (160.0, "edm"))


def thresholds(tracks: DataFrame, base: float, slow: float = 1.08, fast: float = 0.92, gain: float = 0.2, low: float = 0.85, high: float = 1.15) -> DataFrame:
    """tracks (bpm, mdd; null or 0: unknown) with peak_ratio, base scaled by tempo (under 90, over 140) and dynamics within low..high, and rms_ratio."""
    inside = lambda v: min(high, max(low, v))
    # Multipliers, tempos and limits are fixed values.
    tempo = F.when(F.col("bpm") > 140, inside(fast)).when((F.col("bpm") > 0) & (F.col("bpm") < 90), inside(slow)).otherwise(1.0)
    dynamics = F.when(F.col("mdd").isNotNull(), clamp(1 + gain * F.col("mdd"), low, high)).otherwise(1.0)
    peak = clamp(base * tempo * dynamics, 0.05, 0.6)
    return tracks.withColumn("peak_ratio", peak).withColumn("rms_ratio", F.greatest(F.col("peak_ratio") + 0.02, F.least(F.lit(base + 0.06), F.lit(0.72))))


def least_pause(bpm: Column, base: float, strength: float) -> Column:
    """base, shorter in fast tracks and longer in slow ones, at least 0.3; base alone where the tempo is unknown."""
    shift = -0.18 * min(1.5, max(0.0, strength)) * clamp((bpm - 110.0) / 110.0, -1.0, 1.0)
    return F.when(bpm > 0, F.greatest(F.lit(0.3), base + shift)).otherwise(base)


def profile_weights(tracks: DataFrame) -> DataFrame:
    """track, profile, weight: a tempo between two anchors shares itself out between their profiles; outside, the nearest one has all."""
    bpm, parts = F.col("bpm"), []
    for k, (at, name) in enumerate(ANCHORS):
        rise = (bpm - ANCHORS[k - 1][0]) / (at - ANCHORS[k - 1][0]) if k else F.lit(1.0)
        fall = (ANCHORS[k + 1][0] - bpm) / (ANCHORS[k + 1][0] - at) if k + 1 < len(ANCHORS) else F.lit(1.0)
        parts.append(F.struct(F.lit(name).alias("profile"), clamp(F.least(rise, fall)).alias("weight")))
    return tracks.select("track", F.explode(F.array(*parts)).alias("p")).select("track", "p.*").where("weight > 0")


def interpolated(weights: DataFrame, values: DataFrame) -> DataFrame:
    """track, name, value: each profile's values (profile, name, value) in the mean of a track's weights."""
    return weights.join(F.broadcast(values), "profile").groupBy("track", "name").agg(F.round(F.sum(F.col("weight") * F.col("value")), 6).alias("value"))  # a few profiles


def validated_gaps(points: DataFrame, least: float) -> DataFrame:
    """points (track, t, beat: length of a beat) in order: one too near the last kept goes to the beat nearest to its least distance, if that is less
    than a beat behind the point, else it is dropped. moved tells which."""

    def step(x: dict[str, np.ndarray]) -> list:
        kept, moved, beat = [], [], float(x["beat"][0])
        for t in x["t"].tolist():
            near = bool(kept) and t - kept[-1] < least
            if near and (to := round((kept[-1] + least) / beat) * beat) >= t + beat:
                continue
            kept.append(to if near else t)
            moved.append(near)
        return [np.full(len(kept), x["track"][0]), np.arange(len(kept)), np.array(kept), moved]

    return fold(points.select("track", "t", "beat"), ["track"], ["t"], step, "track bigint, ord int, t double, moved boolean")


def least_lengths(cuts: DataFrame, least: float) -> DataFrame:
    """cuts (track, t) in order, each kept if at least so far behind the last kept; the last one of a track always ends the list, in place of the
    last kept if it is nearer."""

    def step(x: dict[str, np.ndarray]) -> list:
        t = x["t"].tolist()
        kept = t[:1]
        for i, at in enumerate(t[1:], 1):
            if at - kept[-1] >= least:
                kept.append(at)
            elif i == len(t) - 1:
                kept[-1] = at
        return [np.full(len(kept), x["track"][0]), np.arange(len(kept)), np.array(kept)]

    return fold(cuts.select("track", "t"), ["track"], ["t"], step, "track bigint, ord int, t double")


def drop_short(segments: DataFrame, micro: float) -> DataFrame:
    """segments (track, seg, start, end, lib) without the end of short ones, but the last and those of the library; what is joined has no library flag."""
    w = Window.partitionBy("track").orderBy("seg")
    short = (F.col("end") - F.col("start") < micro) & ~F.col("lib") & F.lead("seg").over(w).isNotNull()
    x = segments.withColumn("_short", short)
    x = x.withColumn("_g", F.coalesce(F.sum((~F.col("_short")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return x.groupBy("track", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.bool_or("lib") & (F.count("*") == 1)).alias("lib")).drop("_g")
