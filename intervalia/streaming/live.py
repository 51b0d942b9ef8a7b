"""The same figures over a stream: windowed levels with a watermark for late frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_levels(frames: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """frames (ts, track, value) to one row for each track and window; works on streams and on tables."""
    timed = frames.withWatermark("ts", late) if frames.isStreaming else frames
    return timed.groupBy("track", F.window("ts", width)).agg(F.count("*").alias("frames"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms")).select("track", F.col("window.start").alias("start"), "frames", "rms")
