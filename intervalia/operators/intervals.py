"""Intervals (track, start, end): merging, complements, coverage, and joins with points and with each other.

Range joins are equi-joins on (track, time bucket): an interval is listed in the buckets it touches, so no track's points
meet all of its intervals, and a long track is dealt over its buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(intervals: DataFrame, gap: float = 0.0) -> DataFrame:
    """track, start, end and n of maximal chains whose next start is at most gap behind the end so far."""
    before = Window.partitionBy("track").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("track").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce((F.col("start") - F.max("end").over(before) > gap).cast("int"), F.lit(1))
    marked = intervals.withColumn("_opens", opens).withColumn("_chain", F.sum("_opens").over(upto))
    return marked.groupBy("track", "_chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_chain")


def gaps(intervals: DataFrame) -> DataFrame:
    """track, start, end of what lies between merged intervals."""
    w = Window.partitionBy("track").orderBy("start")
    return merge(intervals).select("track", F.col("end").alias("start"), F.lead("start").over(w).alias("end")).where(F.col("end").isNotNull())


def coverage(intervals: DataFrame, tracks: DataFrame) -> DataFrame:
    """track and the share of its duration that is covered. tracks: track, duration."""
    clipped = intervals.join(tracks, "track").select("track", F.greatest(F.lit(0.0), "start").alias("start"), F.least("end", "duration").alias("end")).where("end > start")
    total = merge(clipped).groupBy("track").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    return tracks.join(total, "track", "left").select("track", F.when(F.col("duration") > 0, F.coalesce("covered", F.lit(0.0)) / F.col("duration")).otherwise(0.0).alias("coverage"))


def pad(intervals: DataFrame, tracks: DataFrame, by: float) -> DataFrame:
    """Widened on both sides, clamped to the track, and merged."""
    wide = intervals.join(tracks, "track").select("track", F.greatest(F.lit(0.0), F.col("start") - by).alias("start"), F.least(F.col("duration"), F.col("end") + by).alias("end"))
    return merge(wide.where("end > start"))


def edge_windows(intervals: DataFrame, tracks: DataFrame, by: float) -> DataFrame:
    """Merged windows around every start and every end."""
    edges = intervals.select("track", F.explode(F.array("start", "end")).alias("at"))
    return pad(edges.select("track", F.col("at").alias("start"), F.col("at").alias("end")), tracks, by)


def _listed(intervals: DataFrame, width: float) -> DataFrame:
    return intervals.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))


def points_in(points: DataFrame, intervals: DataFrame, width: float = 8.0, how: str = "inner", strict: bool = True) -> DataFrame:
    """points (track, t) with each interval that holds t: start < t < end, or with both ends. Interval columns but track are kept."""
    right = _listed(intervals, width).withColumnRenamed("track", "_track")
    b = F.floor(F.col("t") / width) == F.col("_bucket")
    inside = (F.col("start") < F.col("t")) & (F.col("t") < F.col("end")) if strict else F.col("t").between(F.col("start"), F.col("end"))
    out = points.join(right, (F.col("track") == F.col("_track")) & b & inside, how)
    return out if how in ("left_semi", "left_anti") else out.drop("_track", "_bucket")


def overlapping(left: DataFrame, right: DataFrame, width: float = 8.0) -> DataFrame:
    """Pairs with a positive overlap: left's columns, right's with r_ before them, and overlap. A pair counts in the bucket where its overlap begins."""
    r = _listed(right, width).select(*(F.col(c).alias(f"r_{c}") for c in right.columns), F.col("_bucket").alias("_rb"))
    l_ = _listed(left, width)
    begin = F.greatest("start", "r_start")
    length = F.least("end", "r_end") - begin
    both = l_.join(r, (F.col("track") == F.col("r_track")) & (F.col("_bucket") == F.col("_rb")))
    return both.where((F.floor(begin / width) == F.col("_bucket")) & (length > 0)).withColumn("overlap", length).drop("_bucket", "_rb", "r_track")


def within(points: DataFrame, anchors: DataFrame, tolerance: float) -> DataFrame:
    """points (track, t) with every anchor (track, a) at most tolerance away, and distance."""
    around = anchors.withColumns({"start": F.col("a") - tolerance, "end": F.col("a") + tolerance})
    return points_in(points, around, width=max(1.0, 4 * tolerance), strict=False).drop("start", "end").withColumn("distance", F.abs(F.col("t") - F.col("a"))).where(F.col("distance") <= tolerance)


def nearest(points: DataFrame, anchors: DataFrame) -> DataFrame:
    """points (track, t) with nearest_a and distance; the earlier anchor on ties. One sort of both sides, no join."""
    names = [c for c in points.columns if c not in ("track", "t")]
    both = points.select("track", "t", F.lit(None).cast("double").alias("a"), F.lit(1).alias("_point"), F.struct(*names, F.lit(0).alias("_x")).alias("_row")).unionByName(
        anchors.select("track", F.col("a").alias("t"), "a", F.lit(0).alias("_point")), allowMissingColumns=True
    )
    up = Window.partitionBy("track").orderBy("t", "_point").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("track").orderBy(F.col("t").desc(), "_point").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({"_before": F.last("a", True).over(up), "_behind": F.last("a", True).over(down)}).where("_point = 1")
    d0, d1 = F.col("t") - F.col("_before"), F.col("_behind") - F.col("t")
    take = F.when(d1.isNull() | (d0 <= d1), F.col("_before")).otherwise(F.col("_behind"))
    return found.select("track", "t", *(F.col(f"_row.{n}").alias(n) for n in names), take.alias("nearest_a"), F.abs(F.col("t") - take).alias("distance"))
