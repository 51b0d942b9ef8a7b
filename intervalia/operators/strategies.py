"""Cuts by bars: a grid whose density follows the kind of bar and which silences force, cuts at beats of high bars only, and the refinement of finished cuts by valleys.

Each depends on the cuts before it by little: on how many bars ago the last one was, on a last cut that is near, on whether the one before was moved. So they are scans over blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .adaptation import least_lengths
from .bars import converted, per_bar
from .folds import fold
from .intervals import points_in, within
from .scans import SIZE, scan

_EPS = 1e-12


def uniform_bars(tracks: DataFrame) -> DataFrame:
    """track, bar, start, end of bars of width (tracks: track, duration, width) up to the first boundary at or behind the end."""
    n = F.ceil((F.col("duration") + F.col("width")) / F.col("width")).cast("bigint") - 2
    x = tracks.where("duration > 0 and width > 0").select("track", "width", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), n))).alias("bar"))
    return x.select("track", "bar", (F.col("bar") * F.col("width")).alias("start"), ((F.col("bar") + 1) * F.col("width")).alias("end"))


def as_of(points: DataFrame, frames: DataFrame, column: str) -> DataFrame:
    """points (track, t) with column of the last frame (track, t, idx) up to t. One sort of both sides, no join."""
    names = [c for c in points.columns if c not in ("track", "t")]
    w = Window.partitionBy("track").orderBy("t", "_point", "idx").rowsBetween(Window.unboundedPreceding, 0)
    both = frames.select("track", "t", "idx", column, F.lit(0).alias("_point")).unionByName(points.select("track", "t", F.lit(1).alias("_point"), *names), allowMissingColumns=True)
    return both.withColumn(column, F.last(column, True).over(w)).where("_point = 1").select("track", "t", *names, column)


def density_marks(bars: DataFrame, silences: DataFrame, verse: int, chorus: int, size: int = SIZE) -> DataFrame:
    """track, bar, t (its end), since (bars since the cut before) and cut: a bar ends in a cut if so many bars went by, fewer for kinds of chorus, or if a silence (track, t) lies in it, its end
    included."""
    most = max(verse, chorus)
    held = points_in(silences.select("track", "t"), bars.select("track", "bar", "start", "end"), strict=False).where("t > start").select("track", "bar").distinct().withColumn("_forced", F.lit(1))
    need = F.when(F.col("kind").contains("chorus"), chorus).otherwise(verse)
    rows = bars.select("track", "bar", "end", need.cast("bigint").alias("need")).join(held, ["track", "bar"], "left").na.fill({"_forced": 0})

    def run(x: dict[str, np.ndarray], state: tuple[float, ...]) -> tuple[tuple[float, ...], list]:
        count, since, cut = int(state[0]), [], []
        for need, forced in zip(x["need"].tolist(), x["_forced"].tolist()):
            count += 1
            since.append(count)
            cut.append(forced > 0 or count >= need)
            count = 0 if cut[-1] else count
        return (float(count),), [x["track"], x["bar"], x["end"], np.array(since, np.int64), np.array(cut, bool)]

    return scan(rows, "bar", (0.0,), lambda x: [(float(c),) for c in range(most)], run, "track bigint, bar bigint, t double, since bigint, cut boolean", size)


def density_grid(bars: DataFrame, silences: DataFrame, tracks: DataFrame, verse: int, chorus: int, least: float, rate: int, size: int = SIZE) -> DataFrame:
    """track, sample: both ends, the marks and the silences inside the track, without those too near the one before."""
    marks = density_marks(bars, silences, verse, chorus, size).where("cut").select("track", "t")
    quiet = silences.select("track", "t").join(tracks, "track").where("t > 0 and t < duration").select("track", "t")
    ends = tracks.select("track", F.explode(F.array(F.lit(0.0), "duration")).alias("t"))
    merged = least_lengths(marks.unionByName(quiet).unionByName(ends).distinct(), least)
    inner = merged.withColumn("_n", F.max("ord").over(Window.partitionBy("track"))).where("ord > 0 and ord < _n")
    length = F.expr(f"cast(duration * {rate} as bigint)")
    at = inner.join(tracks, "track").select("track", F.expr(f"cast(t * {rate} as bigint)").alias("sample"), length.alias("_length")).where("sample > 0 and sample < _length").select("track", "sample")
    return at.unionByName(tracks.select("track", F.explode(F.array(F.lit(0).cast("bigint"), length)).alias("sample"))).distinct()


def ratio_labels(segments: DataFrame, frames: DataFrame, share: float = 0.3, alone: float = 0.01) -> DataFrame:
    """segments (track, seg, start, end) with vocal_rms, rest_rms and kind: human if the root mean square of frames (track, t, vocal, rest) is over share of the rest's, or over
    alone where the rest is unknown; human too where the vocal is unknown."""
    squares = frames.select("track", "t", (F.col("vocal") * F.col("vocal")).alias("_v"), (F.col("rest") * F.col("rest")).alias("_r"), F.col("vocal").isNotNull().cast("double").alias("_hv"), F.col("rest").isNotNull().cast("double").alias("_hr"))
    x = per_bar(segments.withColumnRenamed("seg", "bar"), squares, ["_v", "_r", "_hv", "_hr"]).withColumnRenamed("bar", "seg")
    v, r = F.sqrt("_v"), F.sqrt("_r")
    human = F.when(F.col("_hv") == 0, True).when(F.col("_hr") == 0, v > alone).otherwise(v > share * r)
    return x.select("track", "seg", "start", "end", v.alias("vocal_rms"), r.alias("rest_rms"), F.when(human, "human").otherwise("music").alias("kind"))


def beat_only_marks(bars: DataFrame, cuts: DataFrame, tracks: DataFrame, per_cut: int, least: float, size: int = SIZE) -> DataFrame:
    """track, bar, t, lib. bars: track, bar (from 0), start, end, high, quiet (whether a cut at its end is allowed). cuts: track, t, made otherwise.

    A high bar whose end is the per_cut-th or later since the last cut, and least behind it, ends in a cut of the library if it is quiet there. In other bars the first given cut more than
    least behind the last cut counts; without one, the bar's end as soon as twice as many bars went by."""
    own = points_in(cuts.select("track", "t"), bars.select("track", "bar", "start", "end"), strict=False).where("t < end").groupBy("track", "bar").agg(F.array_sort(F.collect_list("t")).alias("given"))
    rows = bars.join(tracks, "track").join(own, ["track", "bar"], "left").select("track", "bar", "end", "high", "quiet", "duration", "given")
    # Last cuts that matter to a block lie less than least before it.
    first = bars.where(F.expr(f"bar % {size} = 0 and bar > 0")).select("track", F.expr(f"bar div {size}").alias("_b"), F.col("start").alias("t"))
    anchors = bars.select("track", F.col("end").alias("a")).unionByName(cuts.select("track", F.col("t").alias("a"))).unionByName(tracks.select("track", F.lit(0.0).alias("a"))).distinct()
    near = within(first, anchors, least + 1e-9).where("a <= t").groupBy("track", "_b").agg(F.collect_set("a").alias("near"))
    rows = rows.withColumn("_b", F.expr(f"bar div {size}")).join(near, ["track", "_b"], "left").drop("_b")

    def run(x: dict[str, np.ndarray], state: tuple[float, ...]) -> tuple[tuple[float, ...], list]:
        count, last, made = int(state[0]), state[1], []
        for i, (end, high, quiet, duration, given) in enumerate(zip(x["end"].tolist(), x["high"].tolist(), x["quiet"].tolist(), x["duration"].tolist(), x["given"])):
            count = min(count + 1, 2 * per_cut)
            at, lib = None, bool(high)
            free = end <= duration and end - last >= least
            if lib:
                at = end if count >= per_cut and free and quiet else None
            else:
                at = next((t for t in (given if given is not None else ()) if t > last + least), None)
                at = end if at is None and count >= 2 * per_cut and free else at
            if at is not None:
                made.append((i, float(at), lib))
                last, count = float(at), 0
        rows = np.array([i for i, _, _ in made], np.int64)
        return (float(count), last), [x["track"][rows], x["bar"][rows], np.array([t for _, t, _ in made], np.float64), np.array([lib for _, _, lib in made], bool)]

    def states(x: dict[str, np.ndarray]) -> list[tuple[float, ...]]:
        lasts = [-np.inf, *(x["near"][0] if x["near"][0] is not None else ())]
        return [(float(c), float(t)) for c in range(2 * per_cut + 1) for t in lasts]

    return scan(rows, "bar", (0.0, 0.0), states, run, "track bigint, bar bigint, t double, lib boolean", size)


def beat_only(bars: DataFrame, cuts: DataFrame, tracks: DataFrame, per_cut: int, least: float, rate: int, size: int = SIZE) -> DataFrame:
    """track, sample, flag (of the library): the marks and both ends of the track."""
    marks = beat_only_marks(bars, cuts, tracks, per_cut, least, size)
    return converted(marks.select("track", "t", F.col("lib").alias("flag"), F.col("bar").alias("n")), tracks, rate)


def valley_offers(points: DataFrame, chunks: DataFrame, size: int, rate: float, radius: int, window: int, drop_db: float) -> DataFrame:
    """points (track, n, at: a sample) with offer: the middle of the quietest window within radius samples, if it is drop_db quieter than at the point, else null.
    chunks: finalise.wave_chunks of this size with samples and a halo of radius and window."""
    lengths = chunks.groupBy("track").agg(F.max("chunk").alias("_last"))
    own = F.least("_last", F.expr(f"at div {size}"))
    p = points.join(lengths, "track").select("track", own.alias("chunk"), F.lit(1).alias("part"), "n", "at")
    both = chunks.select("track", "chunk", "offset", "length", "samples", F.lit(0).alias("part")).unionByName(p, allowMissingColumns=True)

    def step(x: dict[str, np.ndarray]) -> list:
        s, offset, length = np.asarray(x["samples"][0], np.float64), int(x["offset"][0]), int(x["length"][0])
        level = np.zeros(0)
        if len(s) >= window:  # of the window that begins at each sample
            level = 20 * np.log10(np.sqrt(np.convolve(s * s, np.ones(window) / window, mode="valid") + _EPS) + _EPS)
        offers = []
        for at in x["at"][1:].tolist():
            lo, hi = max(0, at - radius), min(length, at + radius)
            db = level[max(0, lo - offset) : max(0, hi - window + 1 - offset)] if hi - lo > window else level[:0]
            best = int(db.argmin()) if len(db) else 0
            good = len(db) and db[min(max(at - lo - window // 2, 0), len(db) - 1)] - db[best] >= drop_db
            offers.append(lo + best + window // 2 if good else None)
        return [x["track"][1:], x["n"][1:], x["at"][1:], offers]

    return fold(both, ["track", "chunk"], ["part", "n"], step, "track bigint, n bigint, at bigint, offer bigint")


def valley_refined(boundaries: DataFrame, chunks: DataFrame, words: DataFrame, size: int, rate: float, radius: int, window: int, drop_db: float, least: int, block: int = SIZE) -> DataFrame:
    """track, n, at and refined: boundaries (track, n from 0, at: samples, ascending) moved to their valley, but for both ends of a track. A valley inside a word (track, start, end in seconds)
    isn't taken, nor one within least samples of the right neighbour or of the left one, as that one was refined."""
    w = Window.partitionBy("track").orderBy("n")
    around = boundaries.select("track", "n", "at", F.lag("at").over(w).alias("_left"), F.lead("at").over(w).alias("_right"))
    offered = valley_offers(boundaries, chunks, size, rate, radius, window, drop_db).where("offer is not null").select("track", "n", "offer", (F.col("offer") / rate).alias("t"))
    free = points_in(offered, words.where("end > start").select("track", "start", "end"), how="left_anti")
    rows = around.join(free.drop("t"), ["track", "n"], "left")
    good = F.col("_left").isNotNull() & F.col("_right").isNotNull() & F.col("offer").isNotNull() & (F.col("offer") < F.col("_right") - least)
    rows = rows.select("track", "n", "at", F.coalesce(good, F.lit(False)).alias("good"), F.coalesce("offer", "at").alias("offer"), (F.coalesce("offer", "at") > F.coalesce("_left", F.lit(0)) + least).alias("by_raw"), F.coalesce(F.col("offer") > F.lag("offer").over(w) + least, F.lit(False)).alias("by_moved"))

    def run(x: dict[str, np.ndarray], state: tuple[float, ...]) -> tuple[tuple[float, ...], list]:
        moved, out = state[0] > 0, []
        for good, raw, after in zip(x["good"].tolist(), x["by_raw"].tolist(), x["by_moved"].tolist()):
            moved = good and (after if moved else raw)
            out.append(moved)
        return (float(moved),), [x["track"], x["n"], x["at"], np.where(np.array(out, bool), x["offer"], x["at"])]

    return scan(rows, "n", (0.0,), lambda x: [(0.0,), (1.0,)], run, "track bigint, n bigint, at bigint, refined bigint", block)
