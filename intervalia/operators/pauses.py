"""Pauses and voice spans from levels per frame (track, idx, t, value): thresholds, runs, their scores, merging and classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import clamp, decibels
from .intervals import merge, points_in
from .series import morphology, runs


def _percentile(column: str, share: float) -> Column:
    return F.percentile(column, F.lit(share)).over(Window.partitionBy("track"))


def flagged_until(frames: DataFrame, flag: Column, tracks: DataFrame | None = None) -> DataFrame:
    """track, start, end, first and last idx of each run of true; a run ends where the next frame begins, the last one at the track's
    end (tracks: track, duration) or else at its last frame. open tells that it is the last."""
    w = Window.partitionBy("track").orderBy("idx")
    x = runs(frames.withColumn("_next", F.lead("t").over(w)), flag).where("flag")
    x = x.groupBy("track", "run").agg(F.min("t").alias("start"), F.max(F.struct("idx", "t", "_next")).alias("l"), F.min("idx").alias("first"))
    x = x.select("track", "start", F.col("l._next").alias("end"), F.col("l.t").alias("at"), "first", F.col("l.idx").alias("last"))
    if tracks is not None:
        x = x.join(tracks, "track").withColumn("at", F.col("duration")).drop("duration")
    return x.select("track", "start", F.coalesce("end", "at").alias("end"), "first", "last", F.col("end").isNull().alias("open"))


def valley_pauses(frames: DataFrame, peak_ratio: float, mean_ratio: float, least: float, full: float, focus: DataFrame | None = None, weights: tuple[float, float, float] = (0.6, 0.4, 0.1)) -> DataFrame:
    """track, start, end, confidence, energy and threshold of runs under the smaller of two shares of the peak and the mean level.

    frames has flatness too. A track whose focus windows hold none of its frames is scanned whole. Equal means can differ in their last bits by the order in which they are added, and pauses are
    ranked by them: a track's level is added in order of the frames, a pause's from its last frame to its first, as its SQL does on large tables."""
    whole, end = Window.partitionBy("track"), (Window.unboundedPreceding, Window.unboundedFollowing)
    in_order = whole.orderBy("idx").rowsBetween(*end)
    x = frames.withColumn("threshold", F.least(F.max("value").over(in_order) * peak_ratio, F.avg("value").over(in_order) * mean_ratio))
    low = F.col("value") < F.col("threshold")
    if focus is not None:
        inside = points_in(x.select("track", "idx", "t"), focus.select("track", "start", "end"), strict=False).select("track", "idx").distinct().withColumn("_in", F.lit(True))
        x = x.join(inside, ["track", "idx"], "left").withColumn("_any", F.max(F.col("_in").isNotNull()).over(whole))
        low = low & (F.col("_in").isNotNull() | ~F.col("_any"))
    spans = flagged_until(x.select("track", "idx", "t", low.alias("_low")), F.col("_low")).where(F.col("end") - F.col("start") >= least)
    own = spans.withColumn("idx", F.explode(F.sequence("first", "last"))).join(x.select("track", "idx", "value", "flatness", "threshold"), ["track", "idx"])
    backwards = Window.partitionBy("track", "start", "end", "open").orderBy(F.col("idx").desc()).rowsBetween(*end)
    own = own.withColumns({"energy": F.avg("value").over(backwards), "_flat": F.avg("flatness").over(backwards)})
    found = own.groupBy("track", "start", "end", "open").agg(F.first("energy").alias("energy"), F.first("_flat").alias("_flat"), F.first("threshold").alias("threshold"))
    length = clamp((F.col("end") - F.col("start") - least) / (full - least))
    quiet, flat = clamp(1 - F.col("energy") / F.greatest(F.col("threshold"), F.lit(1e-12))), clamp(1 - F.col("_flat"))
    scored = clamp(weights[0] * length + weights[1] * quiet + weights[2] * flat, 0.1, 0.99)
    return found.select("track", "start", "end", F.when(F.col("open"), 0.8).otherwise(scored).alias("confidence"), "energy", "threshold")


def no_voice(frames: DataFrame, tracks: DataFrame, delta: float, close: int, open_: int, least: float) -> DataFrame:
    """Runs without voice: level over the noise (P10 plus delta, or the middle of P10 and P90 dB), gaps closed, short runs dropped, inverted."""
    x = frames.withColumn("db", decibels(F.col("value")))
    low, high = _percentile("db", 0.10), _percentile("db", 0.90)
    active = x.withColumn("_on", F.col("db") > F.greatest(low + delta, 0.5 * (low + high)))
    shaped = morphology(active, F.col("_on"), close, open_)
    return flagged_until(shaped.select("track", "idx", "t", (~F.col("flag")).alias("_off")), F.col("_off"), tracks).where(F.col("end") - F.col("start") >= least).select("track", "start", "end")


def pause_profile(frames: DataFrame, step: float, delta: float, close: int, open_: int, block: int, interlude: int) -> DataFrame:
    """track, median, P95, rate a minute and share of rests inside singing, class (slow, medium, fast) and multiplier.

    Singing is a level over P5 dB plus delta, closed and opened; a block is a stretch of it of at least block frames, with the rests
    of under interlude frames that it holds. Blocks are found before closing, so that rests exist."""
    x = frames.withColumn("db", decibels(F.col("value")))
    x = x.withColumn("_on", F.col("db") > _percentile("db", 0.05) + delta)
    shaped = morphology(x, F.col("_on"), close, open_).select("track", "idx", F.col("flag").alias("_sung"), "_on")
    blocks = runs(shaped, F.col("_sung")).where("flag").withColumn("_size", F.count("*").over(Window.partitionBy("track", "run"))).where(F.col("_size") >= block)
    inner = runs(blocks.select("track", "idx", "_on", F.col("run").alias("_block")), F.col("_on"), keys=["track", "_block"])
    rests = inner.where("not flag").groupBy("track", "_block", "run").agg(F.count("*").alias("n")).where(F.col("n") < interlude)
    total = blocks.groupBy("track").agg((F.count("*") * step).alias("sung"))
    rest = rests.groupBy("track").agg(F.percentile(F.col("n") * step, F.lit(0.5)).alias("median"), F.percentile(F.col("n") * step, F.lit(0.95)).alias("p95"), F.count("*").alias("n"), (F.sum("n") * step).alias("rest"))
    y = total.join(rest, "track").select("track", "median", "p95", (F.col("n") / (F.col("sung") / 60)).alias("rate"), (F.col("rest") / F.col("sung")).alias("share"))
    slow = (F.col("median") >= 0.60) | (F.col("p95") >= 1.20) | (F.col("share") >= 0.35)
    fast = (F.col("median") <= 0.25) & (F.col("rate") >= 18) & (F.col("share") <= 0.15)
    kind = F.when(slow, "slow").when(fast, "fast").otherwise("medium")
    return y.withColumns({"class": kind, "multiplier": F.when(kind == "slow", 1.08).when(kind == "fast", 0.92).otherwise(1.0)})


def presence(frames: DataFrame, tracks: DataFrame, threshold: Column) -> DataFrame:
    """track, seg, start, end, voiced: stretches of equal state that tile the track."""
    w = Window.partitionBy("track").orderBy("idx")
    x = runs(frames, threshold).groupBy("track", "run", "flag").agg(F.min("t").alias("start"), F.min("idx").alias("idx"))
    x = x.join(tracks, "track").withColumn("seg", F.row_number().over(w) - 1)
    first = F.when(F.col("seg") == 0, 0.0).otherwise(F.col("start"))
    return x.select("track", "seg", first.alias("start"), F.coalesce(F.lead("start").over(w), "duration").alias("end"), F.col("flag").alias("voiced"), "duration")


def presence_cuts(segments: DataFrame, lead: float, least_music: float) -> DataFrame:
    """track and t: lead before the first voice, lead before a voice that follows music of at least least_music, lead behind the last voice."""
    w = Window.partitionBy("track").orderBy("seg")
    x = segments.withColumns({"_ps": F.lag("start").over(w), "_pv": F.lag("voiced").over(w)})
    at = lambda c: F.greatest(F.lit(0.0), F.least(c, F.col("duration")))
    voiced = x.where("voiced and end > start").groupBy("track", "duration").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    edges = voiced.select("track", F.explode(F.array(at(F.col("a") - lead), at(F.col("b") + lead))).alias("t"))
    behind = x.where(f"voiced and _pv = false and start - _ps >= {least_music}").select("track", at(F.col("start") - lead).alias("t"), "_ps").where("t >= _ps").select("track", "t")
    return edges.unionByName(behind).distinct()


def energy_gate(frames: DataFrame, db: float, least_voice: float, least_silence: float) -> DataFrame:
    """Voice spans over a level in dB: short ones are dropped before those with short silences between are merged."""
    spans = flagged_until(frames, F.col("value") >= 10 ** (db / 20)).where(F.col("end") - F.col("start") >= least_voice)
    w = Window.partitionBy("track").orderBy("start")
    opens = F.coalesce((F.col("start") - F.lag("end").over(w) >= least_silence).cast("int"), F.lit(1))
    chained = spans.withColumn("_o", opens).withColumn("_c", F.sum("_o").over(w))
    return chained.groupBy("track", "_c").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_c")


def silence_middles(frames: DataFrame, flag: Column, least: float) -> DataFrame:
    """track and t of the middle of each silence of at least so long; one that lasts to the end gives none."""
    return flagged_until(frames, flag).where(f"not open and end - start >= {least}").select("track", ((F.col("start") + F.col("end")) / 2).alias("t"))


def clip_to_chunks(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """spans (track, chunk, start, end) cut to their chunk's effective range; one that straddles its beginning keeps its start."""
    x = spans.join(chunks.select("track", "chunk", "eff_start", "eff_end"), ["track", "chunk"]).where("end > eff_start and start < eff_end")
    straddles = (F.col("start") < F.col("eff_start")) & (F.col("end") > F.col("eff_start"))
    start = F.when(straddles, F.col("start")).otherwise(F.greatest("start", "eff_start"))
    return x.select("track", "chunk", start.alias("start"), F.least("end", "eff_end").alias("end")).where("end - start > 1e-6")


def focus_gaps(spans: DataFrame, tracks: DataFrame, pad: float, merge_gap: float, least: float) -> DataFrame:
    """Windows around what lies between spans, padded, clamped, merged and of a least width; the whole track where nothing is left."""
    w = Window.partitionBy("track").orderBy("start")
    merged = merge(spans).join(tracks, "track")
    inner = merged.select("track", "duration", F.col("end").alias("start"), F.coalesce(F.lead("start").over(w), "duration").alias("end"))
    head = merged.groupBy("track", "duration").agg(F.min("start").alias("end")).select("track", "duration", F.lit(0.0).alias("start"), "end")
    wide = inner.unionByName(head).where("end > start").select("track", F.greatest(F.lit(0.0), F.col("start") - pad).alias("start"), F.least(F.col("duration"), F.col("end") + pad).alias("end"))
    found = merge(wide, merge_gap).where(F.col("end") - F.col("start") >= least).select("track", "start", "end")
    rest = tracks.join(found, "track", "left_anti").select("track", F.lit(0.0).alias("start"), F.col("duration").alias("end"))
    return found.unionByName(rest)


def compress(pauses: DataFrame, gap: float, most: int) -> DataFrame:
    """Pauses at most gap apart become one (the best confidence, the first one's kind); of these the most confident stay."""
    before = Window.partitionBy("track").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("track").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce((F.col("start") - F.max("end").over(before) > gap).cast("int"), F.lit(1))
    x = pauses.withColumn("_o", opens).withColumn("_c", F.sum("_o").over(upto)).groupBy("track", "_c")
    x = x.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("confidence").alias("confidence"), F.min_by("kind", F.struct("start", "end")).alias("kind"))
    rank = F.row_number().over(Window.partitionBy("track").orderBy(F.col("confidence").desc(), "start"))
    return x.withColumn("_r", rank).where(F.col("_r") <= most).select("track", "start", "end", "confidence", "kind")


def merge_adjacent(pauses: DataFrame, gap: float) -> DataFrame:
    """Pauses in order of start; one at most gap behind the end of the one before joins it and sets the end, even to an earlier one."""
    w = Window.partitionBy("track").orderBy("start", "end")
    opens = F.coalesce((F.col("start") - F.lag("end").over(w) > gap).cast("int"), F.lit(1))
    x = pauses.withColumn("_o", opens).withColumn("_c", F.sum("_o").over(w)).groupBy("track", "_c")
    kind = F.when(F.count("*") > 1, F.lit("true_pause")).otherwise(F.min("kind"))
    return x.agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end"), F.max("confidence").alias("confidence"), kind.alias("kind")).drop("_c")


def context_features(pauses: DataFrame, frames: DataFrame, context: int, columns: list[str]) -> DataFrame:
    """pauses (track, pause, first, last: frames) with the means of each column before, inside and behind, over context frames."""
    spans = pauses.select("track", "pause", "first", "last", F.explode(F.sequence(F.greatest(F.lit(1), F.col("first") - context), F.col("last") + context)).alias("idx"))
    x = spans.join(frames, ["track", "idx"])
    part = {"pre": F.col("idx") < F.col("first"), "in": F.col("idx").between(F.col("first"), F.col("last")), "post": F.col("idx") > F.col("last")}
    return x.groupBy("track", "pause").agg(*(F.avg(F.when(at, F.col(c))).alias(f"{name}_{c}") for name, at in part.items() for c in columns), F.stddev_pop(F.when(part["in"], F.col(columns[0]))).alias("in_std"))


def pause_features(means: DataFrame) -> DataFrame:
    """Drops, rises, shifts and stability from the means of f0, rms, centroid and harmonic around a pause; 0 where the context is missing."""
    ratio = lambda top, low: F.coalesce(top / (low + 1e-10), F.lit(0.0))
    c = F.col
    return means.select(
        "track", "pause",
        F.when(c("pre_f0") > 0, F.coalesce(1 - c("in_f0") / c("pre_f0"), F.lit(0.0))).otherwise(0.0).alias("f0_drop"),
        ratio(c("pre_rms") - c("in_rms"), c("pre_rms")).alias("energy_drop"),
        ratio(c("post_rms") - c("in_rms"), c("in_rms")).alias("energy_rise"),
        ratio(F.abs(c("pre_centroid") - c("in_centroid")), c("pre_centroid")).alias("centroid_shift"),
        F.coalesce(1 - c("in_std") / (c("in_f0") + 1e-10), F.lit(0.5)).alias("stability"),
    )


def pause_confidence(features: DataFrame, breath: float, least: float, weights: tuple[float, float, float, float]) -> DataFrame:
    """features (with duration) and confidence, at most 1 and not bounded below."""
    one = lambda x: F.least(F.lit(1.0), x)
    d = F.col("duration")
    length = F.when(d < breath, 0.3).when(d >= least, one(d)).otherwise(0.5)
    parts = [one(F.col("f0_drop") / 0.5), 1 - F.col("stability"), one(F.col("centroid_shift") / 0.3), length]
    total = reduce(Column.__add__, [w * p for w, p in zip(weights, parts)])
    return features.withColumn("confidence", one(total * (0.7 + 0.3 * one(F.col("energy_drop") / 0.7))))


def classify(pauses: DataFrame, high: float, low: float, least: float, breaths: bool = False) -> DataFrame:
    """pauses that stay, with kind: sure ones, breaths if asked for, and those in between that last at least so long."""
    kind = F.when(F.col("confidence") >= high, "true_pause").when(F.col("confidence") <= low, "breath").when(F.col("duration") >= least, "true_pause")
    kept = pauses.withColumn("kind", kind).where("kind is not null")
    return kept if breaths else kept.where("kind != 'breath'")


def as_candidates(pauses: DataFrame, breath_scale: float) -> DataFrame:
    """track, t, score, source of pauses (cut, confidence, kind); breaths count breath_scale times, or not at all."""
    breath = F.col("kind").startswith("breath")
    x = pauses.select("track", F.col("cut").alias("t"), clamp(F.when(breath, F.col("confidence") * breath_scale).otherwise(F.col("confidence"))).alias("score"), F.when(breath, "breath").otherwise("acoustic_pause").alias("source"))
    return x if breath_scale > 0 else x.where("source != 'breath'")


def cap_valleys(pauses: DataFrame, tracks: DataFrame, segment: float) -> DataFrame:
    """The quietest pauses of each track (by threshold less energy, then confidence), one for each segment length, one at least."""
    w = Window.partitionBy("track").orderBy((F.col("threshold") - F.col("energy")).desc(), F.col("confidence").desc(), "start")
    x = pauses.join(tracks, "track").withColumn("_r", F.row_number().over(w))
    return x.where(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("duration") / segment))).drop("_r", "duration")


def boost(pauses: DataFrame, frames: DataFrame, around: int, gain: float, low: float, high: float) -> DataFrame:
    """pauses (track, pause, mid: a frame) with dynamics, from level, flatness and onsets around, and the confidence raised by it."""
    whole = Window.partitionBy("track")
    near = Window.partitionBy("track").orderBy("idx").rowsBetween(-around, around)
    level = F.avg("value").over(near) / F.max("value").over(whole)
    mdd = clamp((clamp(level) + clamp(1 - F.avg("flatness").over(near)) + clamp(F.sum("onset").over(near) / 5)) / 3)
    x = pauses.join(frames.select("track", F.col("idx").alias("mid"), mdd.alias("mdd")), ["track", "mid"])
    factor = F.greatest(F.lit(low), F.least(F.lit(high), 1 + F.col("mdd") * gain))
    return x.withColumns({"confidence": clamp(F.col("confidence") * factor), "kind": F.concat("kind", F.lit("_mdd"))})


def precise_cut(pauses: DataFrame, frames: DataFrame, ahead: int, allowance: float) -> DataFrame:
    """track, pause, cut and grade: the quietest frame of the pause, then the quietest of the next few; the middle, graded B, where that is too loud."""
    w = Window.partitionBy("track").orderBy("idx")
    best = F.min(F.struct("value", "idx", "t")).over(w.rowsBetween(0, ahead))
    floor = F.percentile("value", F.lit(0.05)).over(Window.partitionBy("track"))
    f = frames.withColumns({"_g": best, "_floor": floor})
    x = pauses.withColumn("idx", F.explode(F.sequence("first", "last"))).join(f, ["track", "idx"])
    y = x.groupBy("track", "pause", "start", "end").agg(F.min(F.struct("value", "idx", "_g", "_floor")).alias("m"))
    good = F.col("m._g.value") <= F.col("m._floor") * allowance
    return y.select("track", "pause", F.when(good, F.col("m._g.t")).otherwise((F.col("start") + F.col("end")) / 2).alias("cut"), F.when(good, "A").otherwise("B").alias("grade"))
