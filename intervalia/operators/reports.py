"""Reports on segments, cuts and words of tracks: quality metrics, acceptance figures, gates, guardrails, summaries, differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import clamp
from .intervals import coverage, points_in


def _left(tracks: DataFrame, *parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "track", "left"), parts, tracks)


def _inside(cuts: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    held = points_in(cuts.select("track", "cut", "t"), spans.where("end > start").select("track", "start", "end"), how="left_semi")
    return held.groupBy("track").agg(F.count("*").alias(name))


def qa_report(tracks: DataFrame, segments: DataFrame, cuts: DataFrame, words: DataFrame, regions: DataFrame) -> DataFrame:
    """The thirteen fields of a track's report. tracks: track, duration, fallback_reason; cuts: track, cut, t, score, sources, beat_affinity,
    guard_shift_ms; words and regions: track, start, end, confidence.

    Cuts at the ends of a track count for averages only. Rates are 0 where there is nothing to count, averages and quantiles null."""
    fits = F.avg(F.when(F.col("duration_s").between(5, 15), 1.0).otherwise(0.0))
    seg = segments.groupBy("track").agg(F.count("*").alias("segments_count"), F.median("duration_s").alias("median_segment_s"), fits.alias("_fits"))
    inner = cuts.join(tracks.select("track", "duration"), "track").where("t > 1e-9 and t < duration - 1e-9").drop("duration")
    shift = F.abs("guard_shift_ms")
    every = cuts.groupBy("track").agg(F.avg("score").alias("avg_boundary_score"), F.percentile(shift, F.lit(0.5)).alias("guard_shift_p50_ms"), F.percentile(shift, F.lit(0.95)).alias("guard_shift_p95_ms"))
    aligned = F.array_contains("sources", "beat") | (F.coalesce("beat_affinity", F.lit(0.0)) >= 0.8)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    own = inner.groupBy("track").agg(F.count("*").alias("_cuts"), share(F.array_contains("sources", "breath")).alias("_breath"), share(aligned).alias("_beat"))
    sung = words.groupBy("track").agg(F.avg("confidence").alias("asr_avg_confidence"))
    x = _left(tracks, seg, every, own, sung, _inside(inner, words, "_word"), _inside(inner, regions, "_sung"), coverage(words.where("end > start"), tracks.select("track", "duration")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rate = lambda c: zero(F.col(c) / F.col("_cuts"))
    return x.select(
        "track", F.coalesce("segments_count", F.lit(0)).alias("segments_count"), "median_segment_s", zero(F.col("_fits")).alias("segment_5_15_pass_rate"),
        rate("_word").alias("cut_inside_word_rate"), rate("_sung").alias("cut_inside_singing_rate"), "avg_boundary_score", F.when(F.col("duration") > 0, F.col("coverage")).alias("lyrics_coverage_ratio"),
        "asr_avg_confidence", "guard_shift_p50_ms", "guard_shift_p95_ms", zero(F.col("_breath")).alias("breath_cut_ratio"), zero(F.col("_beat")).alias("beat_aligned_ratio"), "fallback_reason",
    )


def cut_errors(tracks: DataFrame, errors: DataFrame) -> DataFrame:
    """Mean, median, P95 and largest absolute error (track, ms); zeros for a track without any."""
    e = F.abs("ms")
    x = errors.groupBy("track").agg(F.avg(e).alias("mean"), F.percentile(e, F.lit(0.5)).alias("p50"), F.percentile(e, F.lit(0.95)).alias("p95"), F.max(e).alias("largest"))
    return tracks.select("track").join(x, "track", "left").na.fill(0.0)


def acceptance(cuts: DataFrame, words: DataFrame, sure_regions: DataFrame, segments: DataFrame, matched: DataFrame, references: DataFrame) -> DataFrame:
    """One row of figures over all tracks, each a ratio of sums: F1 of matched cuts in tracks that have references, rates of cuts inside
    words and sure regions, share of segments of 5 to 15 seconds. Null where nothing is there to divide by."""
    n = lambda df, name, what=F.count("*"): df.agg(what.cast("bigint").alias("n")).select(F.lit(name).alias("name"), "n")
    held = lambda spans: points_in(cuts, spans.where("end > start").select("track", "start", "end"), how="left_semi")
    judged = cuts.join(references.select("track").distinct(), "track", "left_semi")
    fits = F.sum(F.when(F.col("duration_s").between(5, 15), 1).otherwise(0))
    parts = [n(cuts, "cuts"), n(words, "words"), n(held(words), "_word"), n(held(sure_regions), "_sung"), n(segments, "segments"), n(segments, "_fit", fits), n(matched, "_tp"), n(judged, "_pred"), n(references, "_refs")]
    names = ["cuts", "words", "_word", "_sung", "segments", "_fit", "_tp", "_pred", "_refs"]
    row = reduce(DataFrame.unionByName, parts).agg(*(F.max(F.when(F.col("name") == x, F.col("n"))).alias(x) for x in names))
    ratio = lambda a, b: F.when(b > 0, a / b)
    c = F.col
    return row.select(
        ratio(2 * c("_tp"), c("_pred") + c("_refs")).alias("boundary_f1"), ratio(c("_word"), c("cuts")).alias("cut_inside_word_rate"),
        ratio(c("_sung"), c("cuts")).alias("cut_inside_sure_singing_rate"), ratio(c("_fit"), c("segments")).alias("segment_5_15_pass_rate"), "cuts", "words", "segments",
    )


def gates(figures: DataFrame, thresholds: dict[str, float], upper: tuple[str, ...]) -> DataFrame:
    """gate, value, threshold and status of each figure: at most the threshold for upper ones, at least for others; null is insufficient_data."""
    rows = [F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), F.lit(t).alias("threshold"), F.lit(k in upper).alias("_upper")) for k, t in thresholds.items()]
    x = figures.select(F.explode(F.array(*rows)).alias("g")).select("g.*")
    good = F.when(F.col("_upper"), F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return x.select("gate", "value", "threshold", F.when(F.col("value").isNull(), "insufficient_data").when(good, "pass").otherwise("fail").alias("status"))


def weighted_average(value: Column, weight: Column) -> Column:
    """Sum of value * weight over that of the weights; the plain mean where these are not positive; 0 over nothing."""
    return F.coalesce(F.when(F.sum(weight) > 0, F.sum(value * weight) / F.sum(weight)).otherwise(F.avg(value)), F.lit(0.0))


def guardrails(metrics: DataFrame, tolerance: float) -> DataFrame:
    """metrics (metric, value, kind min or max) with the limit that a later run must keep to: value less or plus the tolerance."""
    low = F.when(F.col("value") > 0, F.col("value") * (1 - tolerance)).otherwise(0.0)
    high = F.when(F.col("value") > 0, F.greatest(F.lit(tolerance), F.col("value") * (1 + tolerance))).otherwise(tolerance)
    return metrics.withColumn("limit", F.when(F.col("kind") == "min", low).otherwise(high))


def violations(limits: DataFrame, now: DataFrame) -> DataFrame:
    """Metrics of now (metric, value) that break their limit, with the change since."""
    x = limits.select("metric", "kind", "limit", F.col("value").alias("base")).join(now.select("metric", "value"), "metric")
    bad = F.when(F.col("kind") == "min", F.col("value") < F.col("limit")).otherwise(F.col("value") > F.col("limit"))
    return x.where(bad).select("metric", "value", "limit", (F.col("value") - F.col("base")).alias("change"))


def regression_summary(segments: DataFrame, low: float, high: float) -> DataFrame:
    d = F.col("duration_s")
    n = lambda c: F.count(F.when(c, 1))
    return segments.groupBy("track").agg(F.count("*").alias("segments"), n(d <= 0).alias("empty"), n(d < low).alias("below"), n(d > high).alias("above"), F.median(d).alias("median_s"), F.avg(d).alias("mean_s"), F.min(d).alias("shortest_s"), F.max(d).alias("longest_s"))


def manifest_diff(before: DataFrame, after: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Keys of which one side lacks the row or a value differs, with state (missing, extra, changed)."""
    a = before.select(*key, F.struct(*values).alias("_a"))
    b = after.select(*key, F.struct(*values).alias("_b"))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full").select(*key, state.alias("state")).where("state is not null")


def style(features: DataFrame) -> DataFrame:
    """features (bpm, mdd, energy_cv, voice_coverage) with the nearest profile and its confidence."""
    c = F.col
    # Limits and confidences are fixed values.
    ballad = (c("bpm") <= 88) & (c("energy_cv") <= 0.25)
    dance = (c("bpm") >= 122) & (c("energy_cv") >= 0.65) & (c("voice_coverage") <= 0.55)
    rap = (c("bpm") >= 118) & (c("mdd") >= 0.45) & (c("voice_coverage") >= 0.68)
    kind = F.when(c("bpm") <= 0, F.struct(F.lit("pop").alias("profile"), F.lit(0.25).alias("confidence")))
    for rule, name, sure in ((ballad, "ballad", 0.78), (dance, "edm", 0.82), (rap, "rap", 0.82)):
        kind = kind.when(rule, F.struct(F.lit(name).alias("profile"), F.lit(sure).alias("confidence")))
    kind = kind.otherwise(F.struct(F.lit("pop").alias("profile"), F.lit(0.70).alias("confidence")))
    return features.withColumn("_s", kind).select(*features.columns, "_s.profile", "_s.confidence")


def separation_confidence(energies: DataFrame) -> DataFrame:
    """From the mean squares of voice, rest (null: unknown) and mix: the voice's share of the mix, averaged with its balance to the rest."""
    share = clamp(F.col("voice") / (F.col("mix") + 1e-8))
    balance = F.col("voice") / (F.col("rest") + 1e-8)
    return energies.withColumn("confidence", clamp(F.coalesce(0.5 * share + 0.5 * clamp(balance / (1 + balance)), share)))


def musical_quality(segments: DataFrame) -> DataFrame:
    """segments (duration_s, beats, low, high, category, complexity, compensation, audio: null if unknown) with quality, a weighted mean of how
    whole its beats are, how well the length fits the expected range and its tempo class, how right the compensation is, and the audio."""
    c, d = F.col, F.col("duration_s")
    whole = clamp(1 - F.abs(c("beats") - F.rint("beats")) / 0.5)
    length = F.when(d.between(c("low"), c("high")), 1.0).otherwise(clamp(F.when(d < c("low"), d / c("low")).otherwise(c("high") / d), 0.2, 1.0))
    ideal = F.when(c("category") == "slow", F.array(F.lit(8.0), F.lit(20.0))).when(c("category") == "medium", F.array(F.lit(6.0), F.lit(15.0))).when(c("category") == "fast", F.array(F.lit(4.0), F.lit(12.0))).otherwise(F.array(F.lit(3.0), F.lit(8.0)))
    fit = F.when(d.between(ideal[0], ideal[1]), 1.0).when(d < ideal[0], F.greatest(F.lit(0.3), d / ideal[0])).otherwise(F.greatest(F.lit(0.3), ideal[1] / d))
    wanted = 1 + c("complexity") * 0.5
    right = F.greatest(F.lit(0.2), 1 - F.abs(c("compensation") - wanted) / wanted)
    total = 0.3 * whole + 0.25 * length + 0.2 * fit + 0.15 * right + F.coalesce(0.1 * c("audio"), F.lit(0.0))
    return segments.withColumn("quality", total / F.when(c("audio").isNull(), 0.9).otherwise(1.0))


def quality_report(segments: DataFrame) -> DataFrame:
    """Per track of segments (duration_s, quality): mean, deviation, range, four classes of quality, and issues."""
    q, d = F.col("quality"), F.col("duration_s")
    n = lambda c: F.count(F.when(c, 1))
    x = segments.groupBy("track").agg(
        F.avg(q).alias("overall"), F.count("*").alias("segments"), F.avg(d).alias("mean_s"), F.stddev_pop(d).alias("std_s"), F.min(q).alias("worst"), F.max(q).alias("best"),
        n(q >= 0.8).alias("excellent"), n((q >= 0.6) & (q < 0.8)).alias("good"), n((q >= 0.4) & (q < 0.6)).alias("fair"), n(q < 0.4).alias("poor"),
    )
    rules = [(F.col("mean_s") < 7, "short"), (F.col("mean_s") > 13, "long"), (F.col("overall") < 0.6, "weak"), (F.col("segments") < 3, "few"), (F.col("segments") > 20, "many")]
    issues = F.array_join(F.array_compact(F.array(*(F.when(rule, name) for rule, name in rules))), ",")
    return x.withColumn("issues", F.when(issues == "", "none").otherwise(issues))


def shift_gate(adjustments: DataFrame, average: float = 150.0, tail: float = 220.0) -> DataFrame:
    """Per track of adjustments (guard_ms, voice_ms, mix_ms): mean, largest and P95 of the absolute shift, means of the positive parts, and whether it passes."""
    s = F.abs("guard_ms")
    up = lambda c: F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0))
    x = adjustments.groupBy("track").agg(F.avg(s).alias("mean_ms"), F.max(s).alias("largest_ms"), F.percentile(s, F.lit(0.95)).alias("p95_ms"), up("voice_ms").alias("voice_ms"), up("mix_ms").alias("mix_ms"), F.count("*").alias("n"))
    return x.withColumn("passes", (F.col("mean_ms") <= average) & (F.col("p95_ms") <= tail))


def manifest(tracks: DataFrame, segments: DataFrame, cuts: DataFrame) -> DataFrame:
    """A nested document a track: duration, ordered segments with labels, ordered cuts. Written by ``write.json``."""
    kind = F.when(F.col("voiced"), "human").otherwise("music")
    s = segments.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("start", "end", kind.alias("kind")))).alias("segments"))
    c = cuts.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("t", "score", "source"))).alias("cuts"))
    named = F.transform("segments", lambda x, i: F.struct(F.format_string("segment_%03d_%s_%.1f", i + 1, x["kind"], x["end"] - x["start"]).alias("name"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return _left(tracks, s, c).select("track", "duration", F.coalesce(named, F.array().cast("array<struct<name:string,start:double,end:double,kind:string>>")).alias("segments"), F.coalesce("cuts", F.array().cast("array<struct<t:double,score:double,source:string>>")).alias("cuts"))
