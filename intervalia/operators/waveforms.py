"""Waves (track, samples: an array): framed levels, crossings, quiet guards, exact cuts, fades. Expressions on arrays; a wave's samples stay in one
row, long tracks come as chunks of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import decibels
from .intervals import within


def _mean_square(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x)


def framed_db(waves: DataFrame, frame: int, hop: int) -> DataFrame:
    """track, frame, db of whole frames, without padding."""
    n = F.greatest(F.lit(0), F.floor((F.size("samples") - frame) / hop).cast("int") + 1)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    x = waves.select("track", "samples", F.explode(starts).alias("frame"))
    return x.select("track", "frame", decibels(F.sqrt(_mean_square(F.slice("samples", F.col("frame") * hop + 1, F.lit(frame))))).alias("db"))


def crossings(waves: DataFrame, rate: float) -> DataFrame:
    """track, a (time) and level of each crossing: between samples of unlike signs by linear interpolation, and at exact zeros."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("samples")), lambda i: F.struct((i - 1).alias("i"), F.element_at("samples", i).alias("l"), F.try_element_at(F.col("samples"), i + 1).alias("r")))
    x = waves.where(F.size("samples") > 0).select("track", F.explode(pairs).alias("p")).select("track", "p.*")
    at = F.when(F.col("l") == 0, 0.0).when(F.col("l") * F.col("r") < 0, F.abs("l") / (F.abs("l") + F.abs("r")))
    return x.withColumn("_at", at).where("_at is not null").select("track", ((F.col("i") + F.col("_at")) / rate).alias("a"), F.least(F.abs("l"), F.coalesce(F.abs("r"), F.abs("l"))).alias("level"))


def snap_to_crossing(points: DataFrame, waves: DataFrame, rate: float, window: float) -> DataFrame:
    """points (track, point, t) with snapped: the nearest crossing within window (the earlier one on ties), else t."""
    near = within(points, crossings(waves, rate), window).groupBy("track", "point").agg(F.min_by("a", F.struct("distance", "a")).alias("_a"))
    return points.join(near, ["track", "point"], "left").withColumn("snapped", F.coalesce("_a", "t")).drop("_a")


def softest_crossing(points: DataFrame, waves: DataFrame, rate: float, window: float) -> DataFrame:
    """points with snapped: of the crossings from t to window behind it that with the smallest level, else t."""
    near = within(points, crossings(waves, rate), window).where("a >= t").groupBy("track", "point").agg(F.min_by("a", F.struct("level", "a")).alias("_a"))
    return points.join(near, ["track", "point"], "left").withColumn("snapped", F.coalesce("_a", "t")).drop("_a")


def quiet_guard(points: DataFrame, waves: DataFrame, half: int, reach: int, guard_db: float, floor_db: float) -> DataFrame:
    """points (track, point, at: a sample) with moved: the quietest sample within reach to the right, by the level of 2 * half + 1 samples around, if
    it is guard_db quieter than at the point and at most floor_db."""
    level = F.transform(F.sequence(F.lit(1), F.size("samples")), lambda i: decibels(F.sqrt(_mean_square(F.slice("samples", F.greatest(F.lit(1), i - half), F.least(F.size("samples"), i + half) - F.greatest(F.lit(1), i - half) + 1)))))
    x = points.join(waves.where(F.size("samples") > 0).select("track", level.alias("_db")), "track")
    ahead = F.slice("_db", F.col("at") + 1, F.lit(reach))
    low = F.array_min(ahead)
    go = (F.element_at("_db", F.col("at") + 1) - low >= guard_db) & (low <= floor_db)
    return x.withColumn("moved", F.when(go, F.col("at") + F.array_position(ahead, low).cast("int") - 1).otherwise(F.col("at"))).drop("_db")


def split_exactly(waves: DataFrame, cuts: DataFrame, least: int) -> DataFrame:
    """track, piece, samples between cuts (track, at: samples): pieces of under least samples are carried into the next one, the last into the one before,
    so that the pieces joined give the wave again."""
    c = cuts.groupBy("track").agg(F.array_sort(F.collect_set("at")).alias("_c"))
    n = F.size("samples")
    x = waves.where(F.size("samples") > 0).join(c, "track", "left").withColumn("_c", F.filter(F.coalesce("_c", F.array().cast("array<int>")), lambda a: (a > 0) & (a < n)))
    kept = F.aggregate("_c", F.array(F.lit(0)), lambda acc, a: F.when(a - F.element_at(acc, -1) >= least, F.concat(acc, F.array(a))).otherwise(acc))
    x = x.withColumn("_k", kept).withColumn("_k", F.when((n - F.element_at("_k", -1) < least) & (F.size("_k") > 1), F.slice("_k", F.lit(1), F.greatest(F.size("_k") - 1, F.lit(0)))).otherwise(F.col("_k")))
    x = x.select("track", "samples", F.posexplode(F.arrays_zip(F.col("_k").alias("a"), F.concat(F.slice("_k", F.lit(2), F.size("_k")), F.array(n)).alias("b"))).alias("piece", "z"))
    return x.select("track", "piece", F.slice("samples", F.col("z.a") + 1, F.col("z.b") - F.col("z.a")).alias("samples"))


def faded(waves: DataFrame, length: int) -> DataFrame:
    """waves with linear ramps of length samples (at most half the wave) at both ends."""
    n = F.least(F.lit(length), F.floor(F.size("samples") / 2).cast("int"))
    ramp = lambda v, i: v * F.least(F.lit(1.0), i / F.greatest(n, F.lit(1)), (F.size("samples") - 1 - i) / F.greatest(n, F.lit(1)))
    return waves.withColumn("samples", F.when(n > 0, F.transform("samples", ramp)).otherwise(F.col("samples")))


def normalised(waves: DataFrame, target_db: float, most: float = 10.0) -> DataFrame:
    """waves at a level of target_db, raised at most `most` times, clipped to -1..1; silence stays."""
    rms = F.sqrt(_mean_square(F.col("samples")))
    gain = F.when(rms > 1e-10, F.least(F.lit(most), F.lit(10 ** (target_db / 20)) / rms)).otherwise(1.0)
    return waves.withColumn("_g", gain).withColumn("samples", F.transform("samples", lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v * F.col("_g"))))).drop("_g")


def quality(waves: DataFrame, window: int, hop: int) -> DataFrame:
    """track, rms, peak, crest_db, voiced (share of windows over a tenth of the level) and silent (share of samples under a twentieth of it)."""
    rms = F.sqrt(_mean_square(F.col("samples")))
    peak = F.array_max(F.transform("samples", lambda v: F.abs(v)))
    starts = F.expr(f"if(size(samples) > {window}, sequence(0, size(samples) - {window} - 1, {hop}), cast(array() as array<int>))")
    loud = F.transform(starts, lambda i: F.sqrt(_mean_square(F.slice("samples", i + 1, F.lit(window)))) > 0.1 * F.col("rms"))
    x = waves.where(F.size("samples") > 0).withColumns({"rms": rms, "peak": peak}).withColumn("_w", loud)
    silent = F.size(F.filter("samples", lambda v: F.abs(v) < 0.05 * F.col("rms"))) / F.size("samples")
    voiced = F.when(F.size("_w") > 0, F.size(F.filter("_w", lambda v: v)) / F.size("_w")).otherwise(0.0)
    return x.select("track", "rms", "peak", F.when(F.col("peak") > 0, 20 * F.log10(F.col("peak") / (F.col("rms") + 1e-10))).otherwise(0.0).alias("crest_db"), voiced.alias("voiced"), silent.alias("silent"))


def boundary_quality(points: DataFrame, waves: DataFrame, window: int, most: float) -> DataFrame:
    """points (track, point, at, edge) with quality: 1, 0.7 or 0.3 as the energy of window samples outside the segment (before a start, behind an
    end) is under most, under twice that or over it, as a share of the wave's; 0.5 where nothing is outside."""
    x = points.join(waves.where(F.size("samples") > 0), "track")
    lo = F.when(F.col("edge") == "start", F.greatest(F.lit(0), F.col("at") - window)).otherwise(F.col("at"))
    hi = F.when(F.col("edge") == "start", F.col("at")).otherwise(F.least(F.size("samples"), F.col("at") + window))
    x = x.withColumns({"_lo": lo, "_n": F.greatest(hi - lo, F.lit(0))})
    share = _mean_square(F.slice("samples", F.col("_lo") + 1, F.col("_n"))) / (_mean_square(F.col("samples")) + 1e-8)
    return x.select("track", "point", F.when(F.col("_n") == 0, 0.5).when(share < most, 1.0).when(share < 2 * most, 0.7).otherwise(0.3).alias("quality"))
