"""Chunks of tracks with halos, and what is put together again from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def schedule(tracks: DataFrame, chunk: float, overlap: float, halo: float) -> DataFrame:
    """track, chunk, start, end, halo_left, halo_right, eff_start, eff_end. The overlap is at most 0.9 of a chunk, a halo at most half of it;
    there is a left halo from the second chunk on, a right one where more follows. A short track is one chunk without halos."""
    overlap, halo = min(max(overlap, 0.0), 0.9 * chunk), min(max(halo, 0.0), 0.5 * chunk)
    step = chunk - overlap
    last = F.when(F.col("duration") <= chunk, 0).otherwise(F.ceil((F.col("duration") - chunk) / step)).cast("bigint")
    x = tracks.select("track", "duration", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk"))
    x = x.withColumns({"start": F.col("chunk") * step, "end": F.least(F.col("chunk") * step + chunk, F.col("duration"))})
    x = x.withColumns({"halo_left": F.when(F.col("chunk") > 0, halo).otherwise(0.0), "halo_right": F.when(F.col("end") < F.col("duration"), halo).otherwise(0.0)})
    return x.withColumns({"eff_start": F.col("start") + F.col("halo_left"), "eff_end": F.col("end") - F.col("halo_right")}).drop("duration")


def recognition_plan(tracks: DataFrame, chunk: float, overlap: float, most: float = 60.0) -> DataFrame:
    """track, chunk, t0, t1: chunks of at most most, each beginning overlap before the end of the one before; the last is cut off."""
    size = min(chunk, most, 60.0)
    if not 0 <= overlap < size:
        raise ValueError("overlap must be shorter than a chunk")
    step = size - overlap
    last = F.when(F.col("duration") <= size, 0).otherwise(F.ceil((F.col("duration") - size) / step)).cast("bigint")
    x = tracks.where("duration > 0").select("track", "duration", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk"))
    return x.select("track", "chunk", F.round(F.col("chunk") * step, 9).alias("t0"), F.round(F.least(F.col("chunk") * step + size, F.col("duration")), 9).alias("t1"))


def _in_chunks(frames: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each frame with every chunk that holds it: frames and chunks meet in time buckets."""
    from .intervals import points_in

    return points_in(frames, chunks, width=32.0, strict=False).where("t < end")


def trimmed(frames: DataFrame, chunks: DataFrame) -> DataFrame:
    """frames (track, t) of each chunk inside its effective range."""
    return _in_chunks(frames, chunks).where("t >= eff_start and t < eff_end")


def stitched(frames: DataFrame, chunks: DataFrame, value) -> DataFrame:
    """track, idx, value and weight: the mean over all chunks whose effective range holds the frame; a frame that none holds has weight 0."""
    found = trimmed(frames, chunks).groupBy("track", "idx").agg(F.sum(value).alias("_sum"), F.count("*").alias("weight"))
    x = frames.select("track", "idx").join(found, ["track", "idx"], "left")
    weight = F.coalesce("weight", F.lit(0))
    return x.select("track", "idx", (F.coalesce("_sum", F.lit(0.0)) / F.greatest(weight, F.lit(1))).alias("value"), weight.alias("weight"))


def merged_words(words: DataFrame, chunks: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """words (track, chunk, start, end, text, confidence; times from their chunk's t0) on the track's time, without what two chunks heard twice.

    In order of (start, end, text) a word repeats the one before if the text is the same and they overlap or their middles are at most
    tolerance apart. Of a chain of repeats the surest stays; a known confidence beats none, and of equal ones that nearest to the middle of
    its chunk stays, then the first."""
    x = words.join(chunks.select("track", "chunk", "t0", "t1"), ["track", "chunk"])
    x = x.withColumns({"start": F.col("t0") + F.col("start"), "end": F.col("t0") + F.col("end")})
    middle = (F.col("start") + F.col("end")) / 2
    x = x.withColumns({"_mid": middle, "_off": F.abs(middle - (F.col("t0") + F.col("t1")) / 2)})
    w = Window.partitionBy("track").orderBy("start", "end", "text", "chunk")
    before = {c: F.lag(c).over(w) for c in ("text", "start", "end", "_mid")}
    again = (F.col("text") == before["text"]) & ((F.least("end", before["end"]) > F.greatest("start", before["start"])) | (F.abs(F.col("_mid") - before["_mid"]) <= tolerance))
    x = x.withColumn("_opens", F.when(F.coalesce(again, F.lit(False)), 0).otherwise(1)).withColumn("_chain", F.sum("_opens").over(w))
    best = F.max_by(F.struct("start", "end", "text", "confidence"), F.struct(F.coalesce("confidence", F.lit(-1.0)), -F.col("_off"), -F.col("start"), -F.col("end"), -F.col("chunk")))
    return x.groupBy("track", "_chain").agg(best.alias("b")).select("track", "b.*")


def sample_slices(spans: DataFrame, waves: DataFrame, rate: int) -> DataFrame:
    """Samples round(start * rate) to round(end * rate) of each track's wave (samples)."""
    a, b = F.rint(F.col("start") * rate).cast("int"), F.rint(F.col("end") * rate).cast("int")
    return spans.join(waves, "track").select("track", "start", "end", F.slice("samples", a + 1, F.greatest(b - a, F.lit(0))).alias("samples"))
