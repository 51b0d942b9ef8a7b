"""Cut candidates (track, cand_id, t, score, source): fusion, scores, pruning, suppression and global planning."""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import clamp
from .folds import fold
from .series import clusters


def fuse(clustered: DataFrame) -> DataFrame:
    """A row for each cluster: the best member (the first on ties), its sources by name, and its size. boundaries.representatives() has more."""
    best = F.max_by(F.struct("t", "cand_id", "score", "source"), F.struct("score", -F.col("t"), -F.col("cand_id"))).alias("b")
    return clustered.groupBy("track", "cluster").agg(best, F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("members")).select("track", "cluster", "b.t", "b.cand_id", "b.score", "b.source", "sources", "members")


def net_value(candidates: DataFrame) -> DataFrame:
    """score less a quarter of the clamped risk and 0.15 of the clamped conflict."""
    return candidates.withColumn("value", F.col("score") - 0.25 * clamp(F.coalesce("risk", F.lit(0.0))) - 0.15 * clamp(F.coalesce("conflict", F.lit(0.0))))


def top_per_bucket(candidates: DataFrame, k: int, width: float = 1.0) -> DataFrame:
    w = Window.partitionBy("track", F.floor(F.col("t") / width)).orderBy(F.col("score").desc(), "t", "cand_id")
    return candidates.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def prune(candidates: DataFrame, tracks: DataFrame, k: int, width: float = 1.0) -> DataFrame:
    """Candidates inside their track; of each time bucket the k with the largest value."""
    inside = candidates.join(tracks, "track").where("t > 0 and t < duration")
    w = Window.partitionBy("track", F.floor(F.col("t") / width)).orderBy(F.col("value").desc(), "t", "cand_id")
    return inside.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= max(1, k)).drop("_rank", "duration")


def suppress(candidates: DataFrame, gap: float, topk: int | None = None, per_window: int | None = None, window: float = 10.0) -> DataFrame:
    """Kept candidates: by falling score, those at least gap from all kept before, at most per_window in each window of time and topk a track.

    What lies gap or more apart can't suppress each other, so a track falls into chains of closer points (and, with limits, stays whole)."""
    span = max(window, gap, 1e-6)

    def step(x: dict[str, np.ndarray]) -> list:
        kept: list[float] = []
        rows, inside = [], {}
        for i, t in enumerate(x["t"].tolist()):
            at = bisect.bisect_left(kept, t)
            if (at and t - kept[at - 1] < gap) or (at < len(kept) and kept[at] - t < gap):
                continue
            bucket = t // span
            if per_window is not None and inside.get(bucket, 0) >= per_window:
                continue
            inside[bucket] = inside.get(bucket, 0) + 1
            kept.insert(at, t)
            rows.append(i)
            if topk is not None and len(rows) >= topk:
                break
        return [x[c][rows] for c in ("track", "cand_id", "t", "score")]

    own = candidates.select("track", "cand_id", "t", "score")
    whole = topk is not None or per_window is not None
    chained = own.withColumn("cluster", F.lit(0)) if whole else clusters(own, gap, ["cand_id"], open_at=True)
    return fold(chained, ["track", "cluster"], [F.col("score").desc(), "t", "cand_id"], step, "track bigint, cand_id bigint, t double, score double")


def plan(candidates: DataFrame, tracks: DataFrame, low: float, high: float, target: tuple[float, float]) -> DataFrame:
    """track, ord, t and role (edge, cut, rescue) of the best path from 0 to the duration with steps of low to high.

    A path's worth is the sum of its candidates' scores and of 1 for each step in the target range, falling to 0 at the hard
    limits; the earliest parent wins ties. Where no path exists the track is split into equal parts."""

    def worth(length: np.ndarray) -> np.ndarray:
        return np.clip(np.minimum((length - low) / (target[0] - low), (high - length) / (high - target[1])), 0.0, 1.0)

    def step(x: dict[str, np.ndarray]) -> list:
        dur = float(x["duration"][0])
        own = (x["t"] > 0) & (x["t"] < dur)  # not where it is unknown
        t = np.concatenate([[0.0], x["t"][own], [dur]])
        value = np.concatenate([[0.0], x["score"][own], [0.0]])
        best, parent = np.full(len(t), -np.inf), np.full(len(t), -1)
        best[0] = 0.0
        lo = 0
        for j in range(1, len(t)):
            while t[j] - t[lo] > high + 1e-9:
                lo += 1
            hi = min(j, int(np.searchsorted(t, t[j] - low + 1e-9, side="right")))
            if lo < hi and (total := best[lo:hi] + value[j] + worth(t[j] - t[lo:hi])).max() > -np.inf:
                at = int(total.argmax())
                best[j], parent[j] = total[at], lo + at
        if best[-1] > -np.inf:
            path = [len(t) - 1]
            while path[-1]:
                path.append(int(parent[path[-1]]))
            times, role = t[path[::-1]], "cut"
        else:
            n = max(1, int(np.ceil(dur / high)))
            if dur / n < low:
                n = max(1, int(dur // low))
            times, role = np.linspace(0.0, dur, n + 1), "rescue"
        roles = ["edge", *[role] * (len(times) - 2), "edge"][: len(times)]
        return [np.full(len(times), x["track"][0]), np.arange(len(times)), np.asarray(times), roles]

    rows = tracks.join(candidates.select("track", "cand_id", "t", "score"), "track", "left").select("track", "duration", "cand_id", "t", "score")
    return fold(rows, ["track"], ["t", "cand_id"], step, "track bigint, ord int, t double, role string")


def optimal(candidates: DataFrame, tracks: DataFrame, low: float, high: float, target: tuple[float, float], penalty: float) -> DataFrame:
    """track, ord, t, cand_id (null at edges and rescue points) and role of the best path from 0 to the duration with steps of low to high.

    A path's worth is the sum of its candidates' values and of 0.1 for each step in the target range, else less penalty times the
    distance from the range in units of its upper end; the earliest parent wins ties. In tracks of up to low every step is
    allowed. Where no path exists the track is split into equal parts of at most high."""

    def fold_step(x: dict[str, np.ndarray]) -> list:
        dur = float(x["duration"][0])
        own = (x["t"] > 0) & (x["t"] < dur)  # not where it is unknown
        t = np.concatenate([[0.0], x["t"][own], [dur]])
        value = np.concatenate([[0.0], x["value"][own], [0.0]])
        ids = [None, *(int(i) for i in x["cand_id"][own]), None]
        best, parent = np.full(len(t), -np.inf), np.full(len(t), -1)
        best[0] = 0.0
        for j in range(1, len(t)):
            lo, hi = (0, j) if dur <= low else (int(np.searchsorted(t, t[j] - high - 1e-9)), min(j, int(np.searchsorted(t, t[j] - low + 1e-9, side="right"))))
            step = t[j] - t[lo:hi]
            allowed = (dur <= low) | ((step >= low) & (step <= high))
            short, long = np.maximum(target[0] - step, 0.0), np.maximum(step - target[1], 0.0)
            worth = np.where(short + long > 0, -penalty * (short + long) / max(target[1], 1e-6), 0.1)
            total = np.where(allowed, best[lo:hi] + value[j] + worth, -np.inf)
            if len(total) and total.max() > -np.inf:
                at = int(total.argmax())
                best[j], parent[j] = total[at], lo + at
        if best[-1] > -np.inf:
            path = [len(t) - 1]
            while path[-1]:
                path.append(int(parent[path[-1]]))
            path = path[::-1]
            times, names, role = [float(t[i]) for i in path], [ids[i] for i in path], "cut"
        else:
            n = max(1, int(np.ceil(dur / max(high, 1e-6))))
            if dur / n < low and n > 1:
                n = max(1, int(dur // max(low, 1e-6)))
            times, role = [*(round(k * dur / n, 9) for k in range(n)), dur], "rescue"
            names = [None] * len(times)
        roles = ["edge", *[role] * (len(times) - 2), "edge"][: len(times)]
        return [np.full(len(times), x["track"][0]), np.arange(len(times)), np.asarray(times), names, roles]

    rows = tracks.where("duration > 0").join(candidates.select("track", "cand_id", "t", "value"), "track", "left").select("track", "duration", "cand_id", "t", "value")
    return fold(rows, ["track"], ["t", "cand_id"], fold_step, "track bigint, ord int, t double, cand_id bigint, role string")


def match_one_to_one(predicted: DataFrame, reference: DataFrame, tolerance: float) -> DataFrame:
    """track, t, r: predicted cuts in order take the nearest reference not yet used within tolerance; the later one wins ties."""

    def step(x: dict[str, np.ndarray]) -> list:
        refs, used, rows = x["t"][x["kind"] == 0], set(), []
        for t in x["t"][x["kind"] == 1].tolist():
            near = [i for i in range(*np.searchsorted(refs, [t - tolerance - 1e-9, t + tolerance + 1e-9])) if i not in used and abs(refs[i] - t) <= tolerance]
            if near:
                best = min(near, key=lambda i: (abs(refs[i] - t), -i))
                used.add(best)
                rows.append((x["track"][0], t, refs[best]))
        return [list(c) for c in zip(*rows)] or [[], [], []]

    both = predicted.select("track", "t", F.lit(1).alias("kind")).unionByName(reference.select("track", F.col("r").alias("t"), F.lit(0).alias("kind")))
    chains = clusters(both, tolerance, ["kind"])  # what lies further apart can't match
    return fold(chains, ["track", "cluster"], ["t", "kind"], step, "track bigint, t double, r double")


def snap_to_grid(points: DataFrame, anchors: DataFrame, tolerance: float, least: float) -> DataFrame:
    """Points moved to their nearest anchor within tolerance, then kept in order if least apart from the last kept one."""
    from .intervals import nearest
    from .series import greedy_gap

    moved = nearest(points.select("track", "t"), anchors.select("track", "a"))
    return greedy_gap(moved.select("track", F.when(F.col("distance") <= tolerance, F.col("nearest_a")).otherwise(F.col("t")).alias("t")), least)
