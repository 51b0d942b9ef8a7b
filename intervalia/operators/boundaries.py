"""Features of cut candidates (track, cand_id, t) against words, regions, sentence ends and anchors, their linear score, and candidate pools.

Each feature is a list of (cand_id, feature, value); lists are stacked and pivoted by one aggregate, so a candidate is shuffled once
however many features it has. All values lie in [0, 1]; a candidate that nothing touches has 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import clamp, confidence_penalty
from .intervals import nearest, points_in, within

#: Default weights of the features; the penalties are subtracted. Fixed values.
WEIGHTS = {"acoustic_pause": 0.35, "asr_gap": 0.20, "sentence_end": 0.15, "beat_affinity": 0.08, "mdd_affinity": 0.10, "breath": 0.12, "inside_word_penalty": 0.80, "singing_penalty": 0.50}
PENALTIES = ("inside_word_penalty", "singing_penalty")


def _named(name: str, found: DataFrame, value: Column) -> DataFrame:
    return found.groupBy("cand_id").agg(value.alias("value")).select("cand_id", F.lit(name).alias("feature"), "value")


def inside_word(points: DataFrame, words: DataFrame, edge: float) -> DataFrame:
    """Penalty of the first word (by start, end) that holds t: by its confidence, falling to 0 within edge of its borders."""
    soft = clamp(F.least(F.col("t") - F.col("start"), F.col("end") - F.col("t")) / F.lit(edge)) if edge > 0 else F.lit(1.0)
    return _named("inside_word_penalty", points_in(points, words), F.min_by(confidence_penalty(F.col("confidence")) * soft, F.struct("start", "end")))


def inside_region(points: DataFrame, regions: DataFrame) -> DataFrame:
    """The same for regions, without soft borders."""
    return _named("singing_penalty", points_in(points, regions), F.min_by(confidence_penalty(F.col("confidence")), F.struct("start", "end")))


def word_gap(points: DataFrame, words: DataFrame, norm: float) -> DataFrame:
    """Length, as a share of norm, of the first gap between consecutive words (by start, end) that holds t, borders included."""
    w = Window.partitionBy("track").orderBy("start", "end")
    between = words.select("track", F.row_number().over(w).alias("n"), F.col("end").alias("start"), F.lead("start").over(w).alias("end")).where("end >= start")
    return _named("asr_gap", points_in(points, between, strict=False), F.min_by(clamp((F.col("end") - F.col("start")) / norm), F.col("n")))


def sentence_end(points: DataFrame, ends: DataFrame, tolerance: float) -> DataFrame:
    """Best of confidence * (1 - distance / tolerance) over sentence ends (track, a, confidence) within tolerance."""
    return _named("sentence_end", within(points, ends, tolerance), F.max(F.coalesce("confidence", F.lit(1.0)) * (1 - F.col("distance") / tolerance)))


def affinity(name: str, points: DataFrame, anchors: DataFrame, tolerance: float) -> DataFrame:
    """1 - distance / tolerance to the nearest anchor within tolerance."""
    return _named(name, within(points, anchors, tolerance), F.max(1 - F.col("distance") / tolerance))


def conflict(points: DataFrame, anchors: DataFrame, tolerance: float) -> DataFrame:
    """Distance to the nearest anchor in tolerances, at most 1; nothing where a track has no anchors."""
    return _named("beat_conflict", nearest(points, anchors).where("nearest_a is not null"), F.max(clamp(F.col("distance") / tolerance)))


def gather(points: DataFrame, lists: list[DataFrame], names: list[str]) -> DataFrame:
    """points with a column for each named feature."""
    stacked = reduce(DataFrame.unionByName, lists)
    wide = stacked.groupBy("cand_id").agg(*(F.max(F.when(F.col("feature") == n, F.col("value"))).alias(n) for n in names))
    return points.join(wide, "cand_id", "left").withColumns({n: clamp(F.coalesce(n, F.lit(0.0))) for n in names})


def linear_score(features: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """features with score: the weighted sum of the columns that have a weight, penalties subtracted, clamped."""
    terms = [(-w if n in PENALTIES else w) * F.col(n) for n, w in weights.items() if n in features.columns]
    return features.withColumn("score", clamp(reduce(Column.__add__, terms, F.lit(0.0))))


def lyrics_candidates(words: DataFrame, sentences: DataFrame, regions: DataFrame, least: float, norm: float) -> DataFrame:
    """track, t, score, source: middles of gaps between words, ends of sentences and both edges of voice regions."""
    w = Window.partitionBy("track").orderBy("start", "end")
    gap = F.col("next") - F.col("end")
    gaps = words.withColumn("next", F.lead("start").over(w)).where(gap >= least).select("track", ((F.col("end") + F.col("next")) / 2).alias("t"), F.least(F.lit(1.0), gap / max(norm, least)).alias("score"), F.lit("lyrics_gap").alias("source"))
    mark = F.when(F.col("text").rlike("[.!?。！？]\\s*$"), 0.85).otherwise(0.75)
    ends = sentences.select("track", F.col("end").alias("t"), clamp(mark * F.coalesce("confidence", F.lit(1.0))).alias("score"), F.lit("sentence_end").alias("source"))
    edges = regions.select("track", F.explode(F.array("start", "end")).alias("t"), (0.45 * F.coalesce("confidence", F.lit(1.0))).alias("score"), F.lit("mvad").alias("source"))
    return gaps.unionByName(ends).unionByName(edges)


def pool(acoustic: DataFrame, lyrics: DataFrame, beats: DataFrame, legacy: bool = False) -> DataFrame:
    """All candidates (track, t, score, source), or the acoustic ones only."""
    return acoustic if legacy else acoustic.unionByName(lyrics).unionByName(beats)


def suppressed(candidates: DataFrame, kept: DataFrame) -> DataFrame:
    """Candidates that weren't kept, told by identity: equal times and scores don't count as the same."""
    return candidates.join(kept.select("cand_id"), "cand_id", "left_anti")


def representatives(clustered: DataFrame) -> DataFrame:
    """For each cluster its best member, sources in order of appearance, the best score of each source, and all members in order."""
    member = F.struct("t", "source", "cand_id", "score")
    best = F.max_by(F.struct("t", "cand_id", "score", "source"), F.struct("score", -F.col("t"), -F.col("cand_id")))
    per_source = clustered.groupBy("track", "cluster", "source").agg(F.min(F.struct("t", "source", "cand_id")).alias("first"), F.max("score").alias("top"), F.collect_list(member).alias("m"), best.alias("b"))
    entries = F.array_sort(F.collect_list(F.struct("first", "source", "top")))
    one = per_source.groupBy("track", "cluster").agg(entries.alias("e"), F.array_sort(F.flatten(F.collect_list("m"))).alias("members"), F.max_by("b", F.struct("b.score", -F.col("b.t"), -F.col("b.cand_id"))).alias("b"))
    return one.select("track", "cluster", "b.*", F.transform("e", lambda x: x["source"]).alias("sources"), F.map_from_entries(F.transform("e", lambda x: F.struct(x["source"], x["top"]))).alias("source_scores"), "members")
