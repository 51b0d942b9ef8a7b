"""Features of ordered levels (track, idx, value, ...): floors, blends, masks, gradients and look-ups. Windows only; a track's rows are sorted once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scoring import clamp


def _track() -> WindowSpec:
    return Window.partitionBy("track")


def _order() -> WindowSpec:
    return Window.partitionBy("track").orderBy("idx")


def rolling_floor(frames: DataFrame, half: int, share: float) -> DataFrame:
    """frames with floor: of the values within half frames, sorted, the one at place int(n * share); windows shrink at the edges."""
    near = F.array_sort(F.collect_list("value").over(_order().rowsBetween(-half, half)))
    at = F.floor(F.size("_near") * F.lit(share)).cast("int")
    return frames.withColumn("_near", near).withColumn("floor", F.element_at("_near", F.least(at + 1, F.size("_near")))).drop("_near")


def dynamics(frames: DataFrame, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """frames (value, flatness, onset) with mdd: shares of the track's largest level and onset and of 1 - flatness, blended and clamped."""
    share = lambda c: F.when(F.max(c).over(_track()) > 0, F.col(c) / F.max(c).over(_track())).otherwise(0.0)
    return frames.withColumn("mdd", clamp(weights[0] * share("value") + weights[1] * (1 - clamp(F.col("flatness"))) + weights[2] * share("onset")))


def quantile_scaled(frames: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """frames with scaled: 0 at the track's low quantile, 1 at the high one."""
    q = lambda s: F.percentile("value", F.lit(s)).over(_track())
    return frames.withColumn("scaled", F.when(q(high) > q(low), clamp((F.col("value") - q(low)) / (q(high) - q(low)))).otherwise(0.0))


def gradients(frames: DataFrame) -> DataFrame:
    """frames with gradient (central, one-sided at the ends), and crossings: the share of changes of sign within two frames."""
    before, behind = F.lag("value").over(_order()), F.lead("value").over(_order())
    g = F.when(before.isNull(), behind - F.col("value")).when(behind.isNull(), F.col("value") - before).otherwise((behind - before) / 2)
    turn = F.when((F.col("value") >= 0) != (before >= 0), 1.0).otherwise(0.0)
    return frames.withColumns({"gradient": F.coalesce(g, F.lit(0.0)), "_turn": turn}).withColumn("crossings", F.avg("_turn").over(_order().rowsBetween(-2, 2))).drop("_turn")


def gaussian(frames: DataFrame, sigma: float, radius: int) -> DataFrame:
    """frames with smooth: a weighted mean within radius, the weights scaled to what is there at the edges."""
    import math

    weight = {k: math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)}
    value = lambda k: F.lag("value", -k).over(_order()) if k else F.col("value")
    total = sum((F.coalesce(value(k), F.lit(0.0)) * w for k, w in weight.items()), F.lit(0.0))
    mass = sum((F.when(value(k).isNotNull(), w).otherwise(0.0) for k, w in weight.items()), F.lit(0.0))
    return frames.withColumn("smooth", total / mass)


def _window_all(flag: str, half: int) -> Column:
    w = _order().rowsBetween(-half, half)
    return F.bool_and(flag).over(w) & (F.count("*").over(w) == 2 * half + 1)


def voice_mask(frames: DataFrame, active: Column, close: int = 2, open_: int = 1) -> DataFrame:
    """frames with voiced: active, closed and then opened with windows of 2 * half + 1 frames; beyond the ends nothing is active."""
    x = frames.withColumn("_a", active).withColumn("_b", F.bool_or("_a").over(_order().rowsBetween(-close, close))).withColumn("_c", _window_all("_b", close))
    return x.withColumn("_d", _window_all("_c", open_)).withColumn("voiced", F.bool_or("_d").over(_order().rowsBetween(-open_, open_))).drop("_a", "_b", "_c", "_d")


def breaths(frames: DataFrame) -> DataFrame:
    """frames (value, clarity) with drop (falls by over two deviations of the changes), soft (under P20 of the positive levels) and unclear."""
    step = F.col("value") - F.lag("value").over(_order())
    x = frames.withColumn("_step", step)
    low = F.percentile(F.when(F.col("value") > 0, F.col("value")), F.lit(0.2)).over(_track())
    return x.withColumns({"drop": F.coalesce(F.col("_step") < -2 * F.stddev_pop("_step").over(_track()), F.lit(False)), "soft": F.col("value") < low, "unclear": F.col("clarity") < 0.5 * F.avg("clarity").over(_track())}).drop("_step")


def looked_up(points: DataFrame, frames: DataFrame, hop: float, around: int) -> DataFrame:
    """points (track, t) with the frame at round(t / hop), kept inside the track, and the mean level and onsets within around frames of it."""
    near = _order().rowsBetween(-around, around)
    x = frames.select("track", "idx", F.avg("value").over(near).alias("level"), F.sum("onset").over(near).alias("onsets"))
    last = frames.groupBy("track").agg(F.min("idx").alias("_lo"), F.max("idx").alias("_hi"))
    at = F.greatest("_lo", F.least("_hi", F.rint(F.col("t") / hop).cast("int")))
    return points.join(last, "track").withColumn("idx", at).drop("_lo", "_hi").join(x, ["track", "idx"])
