"""Rewriting of ordered segments (track, seg, start, end, kind): merges of short ones, splits of long ones, labels.

A rewrite depends on what was rewritten before it, so each track's segments are folded in one group; a track has few segments, and
its frames never enter the group."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold

_SEGMENTS = "track bigint, seg int, start double, end double, kind string"


def from_cuts(plan: DataFrame, kind: str = "human") -> DataFrame:
    """Segments between the ordered times of a plan (track, ord, t)."""
    w = Window.partitionBy("track").orderBy("ord")
    rows = plan.withColumn("end", F.lead("t").over(w)).where("end > t")
    return rows.select("track", (F.row_number().over(w) - 1).cast("int").alias("seg"), F.col("t").alias("start"), "end", F.lit(kind).alias("kind"))


def label(segments: DataFrame, frames: DataFrame, active, ratio: float) -> DataFrame:
    """kind is human where the share of the segment's frames (track, t) that are active is at least ratio, else music."""
    w = Window.partitionBy("track").orderBy("t", "_frame").rowsBetween(Window.unboundedPreceding, 0)
    starts = segments.select("track", F.col("start").alias("t"), F.lit(0).alias("_frame"), "seg", F.lit(None).cast("boolean").alias("_on"))
    both = starts.unionByName(frames.select("track", "t", F.lit(1).alias("_frame"), F.lit(None).cast("int").alias("seg"), active.alias("_on")))
    share = both.withColumn("seg", F.last("seg", True).over(w)).where("_frame = 1").groupBy("track", "seg").agg(F.avg(F.col("_on").cast("double")).alias("_share"))
    return segments.drop("kind").join(share, ["track", "seg"], "left").withColumn("kind", F.when(F.col("_share") >= ratio, "human").otherwise("music")).select("track", "seg", "start", "end", "kind")


def refine(segments: DataFrame, micro: float, soft_min: float, soft_max: float) -> DataFrame:
    """Segments under micro join the neighbour with the smaller sum within soft_max (the left one on ties); those under soft_min join the
    cheaper neighbour, another kind costing the sum and one more; those over soft_max are halved until they fit."""

    def step(x: dict[str, np.ndarray]) -> list:
        rows = [list(r) for r in zip(x["start"].tolist(), x["end"].tolist(), x["kind"])]

        def sides(i: int) -> list[tuple[float, int, int]]:
            return [(rows[j + 1][1] - rows[j][0], j, side) for side, j in ((0, i - 1), (1, i)) if 0 <= j < len(rows) - 1]

        def join(j: int, kind: str) -> None:
            rows[j : j + 2] = [[rows[j][0], rows[j + 1][1], kind]]

        i = 0
        while i < len(rows):
            fits = [s for s in sides(i) if s[0] <= soft_max] if rows[i][1] - rows[i][0] < micro else []
            if fits:
                _, j, side = min(fits)
                join(j, rows[j][2] if side == 0 else rows[j + 1][2])
                i = max(0, j - 1)
            else:
                i += 1
        i = 0
        while i < len(rows):
            if rows[i][1] - rows[i][0] < soft_min:
                other = lambda s: rows[s[1] if s[2] == 0 else s[1] + 1][2]
                costs = [(s[0] + (0 if other(s) == rows[i][2] else s[0] + 1), s[2] if other(s) == rows[i][2] else 1 - s[2], s) for s in sides(i) if s[0] <= soft_max]
                if costs:
                    s = min(costs)[2]
                    join(s[1], other(s))
                    i = max(0, s[1] - 1)
                    continue
            i += 1
        out = []
        for start, end, kind in rows:
            n = 1
            while (end - start) / n > soft_max:
                n *= 2
            out += [(start + (end - start) * k / n, start + (end - start) * (k + 1) / n, kind) for k in range(n)]
        starts, ends, kinds = zip(*out)
        return [np.full(len(out), x["track"][0]), np.arange(len(out)), np.array(starts), np.array(ends), list(kinds)]

    return fold(segments.select("track", "start", "end", "kind"), ["track"], ["start", "end"], step, _SEGMENTS)


@dataclass(frozen=True)
class Limits:
    """Lengths of a layout; a step with a length of 0 is left out."""

    micro: float = 0.0
    soft_min: float = 0.0
    soft_max: float = 0.0
    gap: float = 1.0
    snap: float = 0.0
    midpoint: bool = False


class Segments:
    """The ordered segments of one track that a layout rewrites: borders, and the kind between each two."""

    def __init__(self, borders: list[float], kinds: list[str]):
        self.borders, self.kinds = borders, kinds

    def length(self, i: int) -> float:
        return self.borders[i + 1] - self.borders[i]

    def absorb(self, least: float, choose: Callable[[int, bool, bool], int | None]) -> None:
        """Segments shorter than least join the neighbour that choose names (-1 left, 1 right, None neither), whose kind stays; those
        aligned to a library stay as they are. A segment that has grown to the left is judged again with its neighbours."""
        i = 0
        while least > 0 and len(self.kinds) > 1 and i < len(self.kinds):
            short = self.length(i) < least and "_lib" not in self.kinds[i]
            side = choose(i, i > 0, i + 1 < len(self.kinds)) if short else None
            if side is None:
                i += 1
            else:
                border = i if side < 0 else i + 1
                del self.borders[border], self.kinds[i]
                i = max(i - 1, 0) if side < 0 else i

    def sums(self, i: int) -> tuple[float, float]:
        """Lengths with the left and the right neighbour; infinite where there is none."""
        left = self.borders[i + 1] - self.borders[i - 1] if i else np.inf
        right = self.borders[i + 2] - self.borders[i] if i + 2 < len(self.borders) else np.inf
        return left, right

    def micro(self, most: float) -> Callable:
        def choose(i: int, left: bool, right: bool) -> int:
            a, b = (x if most <= 0 or x <= most else np.inf for x in self.sums(i))
            return -1 if left and (not right or a <= b) else 1

        return choose

    def soft_min(self, most: float) -> Callable:
        def choose(i: int, left: bool, right: bool) -> int | None:
            def cost(x: float, there: bool, j: int) -> float:
                over = np.inf if not there or (most > 0 and x > most) else x
                return over + (0.0 if there and self.kinds[j] == self.kinds[i] else x + 1.0)

            a, b = (cost(x, there, j) for x, there, j in zip(self.sums(i), (left, right), (i - 1, i + 1)))
            go_left = a < b or (a == b and left and self.kinds[i - 1] == self.kinds[i])
            return (-1 if left else None) if go_left else (1 if right else None)

        return choose

    def after_splits(self, most: float, micro: float) -> Callable:
        def choose(i: int, left: bool, right: bool) -> int:
            def cost(x: float, j: int) -> tuple[float, float, float]:
                over = max(0.0, x - most) if most > 0 else 0.0
                other = self.kinds[j] != self.kinds[i]
                return 10.0 * other + (100.0 + over if over > 0 and (other or over > micro) else 0.0), over, x

            a, b = self.sums(i)
            return -1 if left and (not right or cost(a, i - 1) <= cost(b, i + 1)) else 1

        return choose

    def gap(self) -> Callable:
        def choose(i: int, left: bool, right: bool) -> int:
            a, b = self.sums(i)
            return -1 if left and (not right or a <= b) else 1

        return choose

    def split(self, most: float, gap: float, where: Callable[[float, float], float | None]) -> None:
        """Splits segments over most where told, unless a part would be shorter than gap; each part is judged again."""
        i = 0
        while most > 0 and i < len(self.kinds):
            a, b = self.borders[i], self.borders[i + 1]
            t = where(a, b) if b - a > most else None
            if t is None or not (a < t < b) or (gap > 0 and min(t - a, b - t) < gap):
                i += 1
            else:
                self.borders.insert(i + 1, t)
                self.kinds.insert(i, self.kinds[i])

    def snap(self, beats: np.ndarray, reach: float, gap: float) -> None:
        """Inner borders go to the nearest beat within reach if both neighbours stay at least gap long."""
        for i in range(1, len(self.borders) - 1) if reach > 0 and len(beats) else []:
            off = np.abs(beats - self.borders[i])
            t = float(beats[off.argmin()])
            if off.min() <= reach and min(t - self.borders[i - 1], self.borders[i + 1] - t) >= gap:
                self.borders[i] = t


class Evidence:
    """What tells where a long segment of one track may be split."""

    def __init__(self, cuts: list[list[float]], frames: np.ndarray, levels: np.ndarray, phrases: np.ndarray, words: np.ndarray, limits: Limits):
        self.cuts, self.t, self.level, self.phrases, self.words, self.limits = cuts, frames, levels, phrases, words, limits

    def in_word(self, t: np.ndarray) -> np.ndarray:
        return ((self.words[:, 0] < t[:, None]) & (t[:, None] < self.words[:, 1])).any(1)

    def worth(self, t: np.ndarray, base: np.ndarray) -> np.ndarray:
        """base, half the affinity to the nearest phrase border within 0.75 s, and 0.75 less inside a word."""
        near = np.clip(1 - np.abs(self.phrases - t[:, None]).min(1, initial=np.inf) / 0.75, 0, 1)
        return base + 0.5 * near - 0.75 * self.in_word(t)

    def where(self, a: float, b: float) -> float | None:
        """The best suppressed cut inside, which is used up; else a quiet place; else, if allowed, the middle."""
        inside = [c for c in self.cuts if a + 1e-3 < c[0] < b - 1e-3]
        if inside:
            best = inside[int(self.worth(np.array([c[0] for c in inside]), np.array([c[1] for c in inside])).argmax())]
            self.cuts.remove(best)
            return best[0]
        t = self.quiet(a + max(0.0, self.limits.gap), b - max(0.0, self.limits.gap))
        return (a + b) / 2 if t is None and self.limits.midpoint else t

    def nearest(self, t: float) -> int:
        at = int(np.clip(np.searchsorted(self.t, t), 1, max(1, len(self.t) - 1)))
        return at - 1 if t - self.t[at - 1] <= self.t[min(at, len(self.t) - 1)] - t else min(at, len(self.t) - 1)

    def quiet(self, a: float, b: float) -> float | None:
        """A valley of the level, or a phrase border that isn't loud, of a worth of at least 0.5; none where the level hardly varies."""
        if len(self.t) <= 2 or b <= a:
            return None
        lo, hi = self.nearest(a), self.nearest(b) + 1
        x = self.level[lo:hi]
        if len(x) < 3 or not np.isfinite(x).all():
            return None
        p5, p25, median, p75 = np.percentile(x, [5, 25, 50, 75])
        if median <= 1e-12 or p75 - p5 <= max(1e-9, 0.02 * median):
            return None
        t = self.t[lo:hi]
        valley = np.flatnonzero((x[1:-1] <= min(p25, 0.75 * median)) & (x[1:-1] <= x[:-2]) & (x[1:-1] <= x[2:]) & (t[1:-1] > a) & (t[1:-1] < b)) + 1
        found = list(zip(self.worth(t[valley], np.maximum(0, (median - x[valley]) / median)).tolist(), t[valley].tolist()))
        for border in self.phrases[(self.phrases > a) & (self.phrases < b)].tolist():
            at = self.nearest(border) - lo
            low = x[max(0, at - 2) : at + 3].min()
            if low <= median and not self.in_word(np.array([border]))[0]:
                found.append((max(0.0, (median - low) / median) + 0.65, border))
        best = max(found, key=lambda f: f[0], default=(0.0, None))  # the first of equals
        return best[1] if best[0] >= 0.5 else None


def lay_out(segments: DataFrame, limits: Limits, suppressed: DataFrame | None = None, frames: DataFrame | None = None, phrases: DataFrame | None = None, words: DataFrame | None = None, beats: DataFrame | None = None) -> DataFrame:
    """segments (track, start, end, kind; they tile their track) rewritten in seven steps: micro merge, merge up to soft_min, splits over soft_max
    (suppressed: track, t, score; frames: track, t, value; phrases: track, a; words: track, start, end), micro merge of what was split, least gap, beat
    snap (beats: track, a). A track of one segment stays as it is. One track at a time is held by a task."""
    part = lambda df, n, t, v, end, kind=F.lit(None).cast("string"): df.select("track", F.lit(n).alias("part"), t.alias("t"), v.cast("double").alias("v"), end.cast("double").alias("end"), kind.alias("kind"))
    none, c = F.lit(None), F.col
    rows = [part(segments, 0, c("start"), none, c("end"), c("kind"))]
    rows += [part(suppressed, 1, c("t"), c("score"), none)] if suppressed is not None else []
    rows += [part(frames, 2, c("t"), c("value"), none)] if frames is not None else []
    rows += [part(phrases, 3, c("a"), none, none)] if phrases is not None else []
    rows += [part(words.where("end > start"), 4, c("start"), none, c("end"))] if words is not None else []
    rows += [part(beats, 5, c("a"), none, none)] if beats is not None else []

    def step(x: dict[str, np.ndarray]) -> list:
        of = [x["part"] == k for k in range(6)]
        if not of[0].any():
            return [[], [], [], [], []]
        segs = Segments([*x["t"][of[0]].tolist(), float(x["end"][of[0]][-1])], list(x["kind"][of[0]]))
        if len(segs.kinds) > 1:
            words_ = np.stack([x["t"][of[4]], x["end"][of[4]]], 1)
            evidence = Evidence([list(z) for z in zip(x["t"][of[1]].tolist(), x["v"][of[1]].tolist())], x["t"][of[2]], x["v"][of[2]], x["t"][of[3]], words_, limits)
            segs.absorb(limits.micro, segs.micro(limits.soft_max))
            segs.absorb(limits.soft_min, segs.soft_min(limits.soft_max))
            segs.split(limits.soft_max, limits.gap, evidence.where)
            segs.absorb(limits.micro, segs.after_splits(limits.soft_max, limits.micro))
            segs.absorb(limits.gap, segs.gap())
            segs.snap(x["t"][of[5]], limits.snap, limits.gap)
        n = len(segs.kinds)
        return [np.full(n, x["track"][0]), np.arange(n), np.array(segs.borders[:-1]), np.array(segs.borders[1:]), segs.kinds]

    return fold(reduce(DataFrame.unionByName, rows), ["track"], ["part", "t", "v"], step, _SEGMENTS)
