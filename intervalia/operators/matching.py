"""Matches between cuts, adjustments, flags and reference positions of a track."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import nearest, overlapping, points_in

#: Chinese characters. Fixed values.
CHINESE = "[\u3400-\u9fff\uf900-\ufaff]"


def restored(adjustments: DataFrame, words: DataFrame) -> DataFrame:
    """adjustments (track, n, raw, final) whose final time goes back to the raw one where it lies inside a word and the raw one doesn't."""
    spans = words.select("track", "start", "end")
    inside = lambda c: points_in(adjustments.select("track", "n", F.col(c).alias("t")), spans, how="left_semi").select("track", "n").withColumn(f"_{c}", F.lit(True))
    x = adjustments.join(inside("raw"), ["track", "n"], "left").join(inside("final"), ["track", "n"], "left")
    back = F.col("_final").isNotNull() & F.col("_raw").isNull()
    return x.select("track", "n", "raw", F.when(back, F.col("raw")).otherwise(F.col("final")).alias("final"), back.alias("restored"))


def with_metadata(cuts: DataFrame, notes: DataFrame, digits: int = 6) -> DataFrame:
    """cuts (track, t) with the note of notes (track, t, n, note) at the same rounded time; the last one (by n) counts."""
    last = notes.groupBy("track", F.round("t", digits).alias("_t")).agg(F.max_by("note", "n").alias("note"))
    return cuts.withColumn("_t", F.round("t", digits)).join(last, ["track", "_t"], "left").drop("_t")


def nearest_adjustment(kept: DataFrame, adjustments: DataFrame) -> DataFrame:
    """kept (track, t) with the nearest final time and its raw one; the first on ties. An adjustment can serve several times."""
    raw = adjustments.groupBy("track", F.col("final").alias("nearest_a")).agg(F.min_by("raw", "n").alias("raw"))
    return nearest(kept, adjustments.select("track", F.col("final").alias("a")).distinct()).join(raw, ["track", "nearest_a"], "left").withColumnRenamed("nearest_a", "final")


def remapped_flags(ends: DataFrame, raw: DataFrame) -> DataFrame:
    """ends (track, t) with the flag of the nearest raw end (track, a, flag); false at the last raw end of a track."""
    last = Window.partitionBy("track")
    flagged = raw.withColumn("_flag", F.col("flag") & (F.col("a") != F.max("a").over(last))).select("track", F.col("a").alias("nearest_a"), "_flag").distinct()
    return nearest(ends, raw.select("track", "a")).join(flagged, ["track", "nearest_a"], "left").select("track", "t", F.coalesce("_flag", F.lit(False)).alias("flag"))


def positional_difference(reference: DataFrame, candidate: DataFrame, rate: int, strict: bool = True) -> DataFrame:
    """track, n, ms between the n-th different positions (track, sample) of both sides. Where a track's counts differ it fails if strict; else positions without a partner have no row."""
    w = Window.partitionBy("track").orderBy("sample")
    numbered = lambda df, name: df.select("track", "sample").distinct().withColumn("n", F.row_number().over(w)).withColumnRenamed("sample", name)
    both = numbered(reference, "_r").join(numbered(candidate, "_c"), ["track", "n"], "full" if strict else "inner")
    ms = F.abs(F.col("_r") - F.col("_c")) * 1000.0 / rate
    if strict:
        ms = F.when(F.col("_r").isNull() | F.col("_c").isNull(), F.raise_error(F.lit("the sides have different counts")).cast("double")).otherwise(ms)
    return both.select("track", "n", ms.alias("ms"))


def boundaries_of(words: DataFrame, sentences: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different word intervals, and different positive ends of sentences and edges of regions, both per track."""
    spans = words.where("end > start").select("track", "start", "end").distinct()
    edges = sentences.select("track", F.col("end").alias("t")).unionByName(regions.select("track", F.explode(F.array("start", "end")).alias("t")))
    return spans, edges.where("t > 0").distinct()


def near_boundaries(adjustments: DataFrame, segments: DataFrame, tolerance: float) -> DataFrame:
    """adjustments (track, n, final) within tolerance of a boundary between two segments (track, seg, end)."""
    last = F.max("seg").over(Window.partitionBy("track"))
    inner = segments.withColumn("_last", last).where("seg < _last").select("track", F.col("end").alias("a"))
    found = nearest(adjustments.select("track", "n", F.col("final").alias("t")), inner).where(F.col("distance") <= tolerance)
    return adjustments.join(found.select("track", "n"), ["track", "n"], "left_semi")


def segment_lyrics(segments: DataFrame, words: DataFrame, share: float = 0.5) -> DataFrame:
    """segments (track, seg, start, end) with the text of their words (track, text, start, end), of those that lie in the segment by this share of their length, in order of start and end; first and last time,
    and how many. Words are joined without blanks if all hold Chinese characters. A segment without words, or that doesn't last, has null and 0."""
    own = segments.where("end > start").select("track", "seg", "start", "end")
    both = overlapping(words.select("track", "text", "start", "end"), own)
    inside = both.where(F.col("overlap") >= share * F.greatest(F.col("end") - F.col("start"), F.lit(1e-9)))
    held = inside.groupBy("track", F.col("r_seg").alias("seg")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("_w"))
    texts = F.col("_w.text")
    joined = F.when(F.forall(texts, lambda x: x.rlike(CHINESE)), F.array_join(texts, "")).otherwise(F.array_join(texts, " "))
    found = held.select("track", "seg", joined.alias("text"), F.get("_w", F.lit(0)).getField("start").alias("first"), F.element_at("_w", -1).getField("end").alias("last"), F.size("_w").cast("bigint").alias("words"))
    return segments.join(found, ["track", "seg"], "left").na.fill(0, ["words"])
