"""Tempo and beats of onset series (track, idx from 0 without gaps, value).

Products of onsets so many frames apart add up, so a tempo comes from sums over chunks of a track with a halo of the longest lag. The beats are the best path
through a track: a beat is worth its onset, less a penalty for a distance from the beat before that differs from the tempo's. A long track goes block by block: what a
block makes of the scores that enter it is a matrix of maxima of sums, which are chained a row of small matrices a track; then all blocks run at once, each with the scores that enter it, and
the path is followed back the same way. So no group holds more than a block of frames, and the beats don't depend on the blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold

#: Frames of a chunk or block.
SIZE = 1 << 16
#: Names of tempos from so many beats a minute on, and the fastest and slowest. Fixed values.
CATEGORIES = ((50.0, "slow"), (80.0, "medium"), (120.0, "fast"), (160.0, "very_fast"), (200.0, "extreme_fast"))


def onset_strength(frames: DataFrame) -> DataFrame:
    """track, idx (from 0) and value: how much a frame's value is above that of the one before, else 0."""
    w = Window.partitionBy("track").orderBy("idx")
    rise = F.greatest(F.lit(0.0), F.col("value") - F.lag("value").over(w))
    return frames.select("track", (F.col("idx") - F.min("idx").over(Window.partitionBy("track"))).alias("idx"), F.coalesce(rise, F.lit(0.0)).alias("value"))


def lag_products(onsets: DataFrame, least: int, most: int, size: int = SIZE) -> DataFrame:
    """track, lag, product: the sum of products of onsets that lie so many frames apart."""
    chunk = F.expr(f"idx div {size}")
    own = onsets.select("track", "idx", "value", F.explode(F.array_distinct(F.array(chunk, F.greatest(F.lit(0), F.expr(f"(idx - {most}) div {size}"))))).alias("chunk"))

    def step(x: dict[str, np.ndarray]) -> list:
        end = (int(x["chunk"][0]) + 1) * size
        v, n = x["value"], int(np.searchsorted(x["idx"], end))
        lags = np.arange(least, most + 1)
        return [np.repeat(x["track"][:1], len(lags)), lags, np.array([v[: max(0, min(n, len(v) - k))] @ v[k : k + max(0, min(n, len(v) - k))] for k in lags])]

    parts = fold(own, ["track", "chunk"], ["idx"], step, "track bigint, lag bigint, part double")
    return parts.groupBy("track", "lag").agg(F.sum("part").alias("product"))


def tempo(products: DataFrame, hop: float, centre: float = 120.0, spread: float = 1.0) -> DataFrame:
    """track, period (the lag of the largest product, each weighed by how many octaves its tempo lies from the centre; the shortest on ties), bpm and strength. hop: seconds a frame.
    A track without products above 0 has none."""
    bpm = 60.0 / (F.col("lag") * hop)
    octaves = (F.log2(bpm) - float(np.log2(centre))) / spread
    x = products.withColumns({"_bpm": bpm, "_s": F.col("product") * F.exp(-0.5 * octaves * octaves)}).where("_s > 0")
    best = F.max_by(F.struct(F.col("lag").alias("period"), F.col("_bpm").alias("bpm"), F.col("_s").alias("strength")), F.struct("_s", -F.col("lag")))
    return x.groupBy("track").agg(best.alias("b")).select("track", "b.*")


class Path:
    """The scores of beats at a period: 2 * period frames enter, a beat lies half to two periods behind the one before."""

    def __init__(self, period: int, tightness: float):
        self.span, self.near = 2 * period, (period + 1) // 2
        self.penalty = -tightness * np.log(np.arange(self.span, self.near - 1, -1) / period) ** 2

    def forward(self, values: np.ndarray, entering: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores, those that entered first, and places of the beats before (from -span on; none is NONE)."""
        score = np.concatenate([entering, np.empty(len(values))])
        parent, wide = np.full(len(values), -self.span - 1), self.span - self.near + 1
        for i, own in enumerate(values.tolist()):
            total = score[i : i + wide] + self.penalty
            at = int(total.argmax())
            score[self.span + i] = own
            if total[at] > 0:
                score[self.span + i] += total[at]
                parent[i] = i + at - self.span
        return score, parent

    def transfer(self, values: np.ndarray) -> np.ndarray:
        """What the block makes of the scores that enter: the leaving ones are the largest of column + score, or of the last column alone."""
        span, wide = self.span, self.span - self.near + 1
        x = np.full((span + len(values), span + 1), -np.inf)
        x[np.arange(span), np.arange(span)] = 0.0
        for i, own in enumerate(values.tolist()):
            best = (x[i : i + wide] + self.penalty[:, None]).max(0)
            best[-1] = max(best[-1], 0.0)
            x[span + i] = own + best
        return x[-span:]


def deviations(onsets: DataFrame) -> DataFrame:
    """track, _d (the sample deviation of its onsets) and n. Paths can be equally good but for the last bits of the deviation, so these mustn't depend on how rows are dealt:
    onsets are taken one by one in their order, and what SIZE of them make is put together in their order."""

    def one(x: dict[str, np.ndarray]) -> list:
        mean = squares = 0.0
        for n, v in enumerate(x["value"].tolist(), 1):
            off = v - mean
            mean += off / n
            squares += off * (v - mean)
        return [x["track"][:1], x["block"][:1], np.array([len(x["value"])]), np.array([mean]), np.array([squares])]

    def whole(x: dict[str, np.ndarray]) -> list:
        n, mean, squares = int(x["n"][0]), float(x["mean"][0]), float(x["squares"][0])
        for more, m, q in zip(x["n"][1:].tolist(), x["mean"][1:].tolist(), x["squares"][1:].tolist()):
            off, n = m - mean, n + more
            mean += off * more / n
            squares += q + off * off * more * (n - more) / n
        return [x["track"][:1], np.array([np.sqrt(squares / (n - 1)) if n > 1 else np.nan]), np.array([n])]

    blocks = fold(onsets.select("track", "idx", "value", F.expr(f"idx div {SIZE}").alias("block")), ["track", "block"], ["idx"], one, "track bigint, block bigint, n bigint, mean double, squares double")
    return fold(blocks, ["track"], ["block"], whole, "track bigint, _d double, n bigint")


def _flat(a: np.ndarray) -> list[bytes]:
    return [a.tobytes()]


def beats(onsets: DataFrame, periods: DataFrame, tightness: float = 100.0, size: int = SIZE) -> DataFrame:
    """track, idx: the beats of the best path that ends within the last period of the track. Onsets are taken in units of their deviation; a track without any, or without a period
    (periods: track, period), has no beats."""
    figures = deviations(onsets).where("_d > 0").join(periods.select("track", "period"), "track")
    own = onsets.join(figures, "track").select("track", F.expr(f"idx div greatest({size}, 2 * period)").alias("block"), "idx", (F.col("value") / F.col("_d")).alias("value"), "period", "n")
    long = own.where(f"n > greatest({size}, 2 * period)")

    def maps(x: dict[str, np.ndarray]) -> list:
        return [x["track"][:1], x["block"][:1], x["period"][:1], x["n"][:1], _flat(Path(int(x["period"][0]), tightness).transfer(x["value"]))]

    def chained(x: dict[str, np.ndarray]) -> list:
        period, n = int(x["period"][0]), int(x["n"][0])
        span = 2 * period
        state, states = np.full(span, -np.inf), []
        for raw in x["map"]:
            states.append(state.tobytes())
            m = np.frombuffer(raw).reshape(span, span + 1)
            state = np.maximum((m[:, :-1] + state).max(1), m[:, -1])
        last = n - period + int(state[-period:].argmax())
        return [x["track"], x["block"], states, np.full(len(states), last)]

    def exits(x: dict[str, np.ndarray]) -> list:
        path, first = Path(int(x["period"][0]), tightness), int(x["idx"][0])
        _, parent = path.forward(x["value"], np.frombuffer(x["state"][0]))
        origin = np.empty(len(parent), np.int64)  # the place before the block from which the path to a beat comes
        for i, p in enumerate(parent.tolist()):
            origin[i] = origin[p] if p >= 0 else p
        return [x["track"][:1], x["block"][:1], np.array([first]), x["period"][:1], x["last"][:1], _flat(origin[-path.span :]), np.array([len(parent)])]

    def chosen(x: dict[str, np.ndarray]) -> list:
        at, ends = int(x["last"][0]), []
        for first, span, raw, n in zip(x["first"].tolist(), (2 * x["period"]).tolist(), x["origin"], x["rows"].tolist()):
            if at < first:  # no beat here, or the path has begun
                ends.append(-1)
                continue
            ends.append(at)
            origin = np.frombuffer(raw, np.int64)
            to = int(origin[at - first - n + len(origin)])
            at = first + to if to >= -span else -1
        return [x["track"], x["block"], np.array(ends)]

    def traced(x: dict[str, np.ndarray]) -> list:
        path, first = Path(int(x["period"][0]), tightness), int(x["idx"][0])
        alone = x["state"][0] is None
        entering = np.full(path.span, -np.inf) if alone else np.frombuffer(x["state"][0])
        score, parent = path.forward(x["value"], entering)
        period = path.span // 2
        at = max(0, len(parent) - period) + int(score[path.span :][-period:].argmax()) if alone else int(x["end"][0]) - first
        found = []
        while at >= 0:
            found.append(at + first)
            at = int(parent[at])
        return [np.repeat(x["track"][:1], len(found)), np.array(found[::-1], np.int64)]

    keys = ["track", "block"]
    states = fold(fold(long, keys, ["idx"], maps, "track bigint, block bigint, period bigint, n bigint, map binary"), ["track"], ["block"], chained, "track bigint, block bigint, state binary, last bigint")
    left = fold(long.join(states, keys), keys, ["idx"], exits, "track bigint, block bigint, first bigint, period bigint, last bigint, origin binary, rows bigint")
    ends = fold(left, ["track"], [F.col("block").desc()], chosen, "track bigint, block bigint, end bigint")
    rows = own.join(states.drop("last").join(ends, keys), keys, "left").where("state is null or end >= 0")
    return fold(rows, keys, ["idx"], traced, "track bigint, idx bigint")


def tempo_features(beat_times: DataFrame, tempos: DataFrame) -> DataFrame:
    """track, bpm, stability (1 less the relative deviation of the beats' distances, 0.5 with under three beats), variance (that deviation; 0.1 there) and category."""
    step = F.col("t") - F.lag("t").over(Window.partitionBy("track").orderBy("t"))
    x = beat_times.withColumn("_step", step).groupBy("track").agg(F.count("*").alias("_n"), (F.stddev_pop("_step") / F.avg("_step")).alias("_v"))
    category = F.lit("very_slow")
    for at, name in CATEGORIES:
        category = F.when(F.col("bpm") >= at, name).otherwise(category)
    many = F.coalesce(F.col("_n") >= 3, F.lit(False))
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_v")))
    return tempos.join(x, "track", "left").select("track", "bpm", F.when(many, 1 - bounded).otherwise(0.5).alias("stability"), F.when(many, bounded).otherwise(0.1).alias("variance"), category.alias("category"))
