"""From raw cuts to final boundaries: suppression, four moves on two waves, least distances; where each cut came from stays attached.

Waves are rows of chunks (track, chunk, offset, length of the track, vocal, mix: arrays with a halo), so a cut is joined with the samples around it only, and a track of any length is many small groups."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .candidates import suppress
from .folds import fold
from .matching import nearest_adjustment
from .series import greedy_gap

_EPS = 1e-12


@dataclass(frozen=True)
class Moves:
    """Samples a second and, in samples, how far the nearest crossing may be, how far to the right a quieter place may be, and how wide a level's window is; in dB how much
    quieter it must be, and the loudest level that counts as quiet."""

    rate: float
    crossing: int
    reach: int
    window: int
    guard_db: float
    floor_db: float

    @property
    def halo(self) -> int:
        return 2 * (self.crossing + self.reach + self.window) + 2


def wave_chunks(waves: DataFrame, size: int, halo: int, columns: tuple[str, ...] = ("vocal", "mix")) -> DataFrame:
    """waves (track and columns: arrays as long as each other) as chunks of so many samples, each with up to halo samples of its neighbours on both sides."""
    n = F.size(columns[-1])
    x = waves.where(n > 0).select("track", *columns, n.cast("bigint").alias("length"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(size({columns[-1]}) - 1) div {size}"))).alias("chunk"))
    offset = F.greatest(F.lit(0), F.col("chunk") * size - halo)
    end = (F.col("chunk") + 1) * size + halo
    return x.select("track", "chunk", offset.cast("bigint").alias("offset"), "length", *(F.slice(c, (offset + 1).cast("int"), (end - offset).cast("int")).alias(c) for c in columns))


class _Wave:
    """A piece of a wave from offset on, of a wave that is n long."""

    def __init__(self, samples: np.ndarray, offset: int, n: int, m: Moves):
        self.s, self.offset, self.n, self.m = samples.astype(np.float64), offset, n, m
        kernel = np.ones(m.window) / m.window
        at = (m.window - 1) // 2
        square = np.convolve(self.s * self.s, kernel)[at : at + len(self.s)]
        self.db = 20 * np.log10(np.sqrt(np.maximum(square, 0) + _EPS) + _EPS)

    def crossing(self, t: float) -> float:
        """The nearest crossing within reach, the earlier one on ties, else t."""
        idx = round(t * self.m.rate)
        lo, hi = max(1, idx - self.m.crossing), min(self.n - 1, idx + self.m.crossing)
        if idx <= 0 or idx >= self.n or hi <= lo:
            return t
        pos = np.arange(lo, hi + 1)
        left, right = self.s[pos - 1 - self.offset], self.s[pos - self.offset]
        size = np.abs(left) + np.abs(right)
        zero = np.where(left == 0, pos - 1.0, np.where(right == 0, pos, pos - 1 + np.where(size > _EPS, np.abs(left) / np.maximum(size, _EPS), 0.5)))
        far = np.where((left == 0) | (right == 0) | (left * right < 0), np.abs(zero - idx), np.inf)
        best = int(far.argmin())
        return t if np.isinf(far[best]) else float(zero[best]) / self.m.rate

    def quieter(self, t: float) -> float:
        """The quietest sample within reach by the level around it; failing that by the level of the window that begins there, whose middle is taken; else t."""
        m = self.m
        idx = min(max(round(t * m.rate), 0), self.n - 1)
        db = self.db[idx - self.offset : min(self.n, idx + m.reach) - self.offset]
        at = int(db.argmin())
        if at and db[0] - db[at] >= m.guard_db and db[at] <= m.floor_db:
            return (idx + at) / m.rate
        idx = max(round(t * m.rate), 0)
        s = self.s[idx - self.offset : max(min(self.n, idx + m.reach), idx) - self.offset]
        if len(s) <= max(1, m.window):  # no place to look for
            return t
        s = np.pad(s, (0, m.window - 1), mode="edge")
        db = 20 * np.log10(np.sqrt(np.convolve(s * s, np.ones(m.window) / m.window, mode="valid") + _EPS) + _EPS)
        at = int(db.argmin())
        if db[0] - db[at] < m.guard_db or db[at] > m.floor_db:
            return t
        return min(self.n - 1, idx + at + m.window // 2) / m.rate


def moved(points: DataFrame, chunks: DataFrame, size: int, m: Moves) -> DataFrame:
    """points (track, point, t, score) with guard, the time after the nearest crossing and the quieter place of the vocal wave, and final, the one after those of the mix too.
    chunks are wave_chunks of this size. Points behind the wave belong to its last chunk; a track without a wave has none."""
    lengths = chunks.groupBy("track").agg(F.max("chunk").alias("_last"))
    own = F.greatest(F.lit(0), F.least("_last", F.floor(F.col("t") * m.rate / size))).cast("bigint")
    p = points.join(lengths, "track").select("track", own.alias("chunk"), F.lit(1).alias("part"), "point", "t", "score")
    both = chunks.select("*", F.lit(0).alias("part")).unionByName(p, allowMissingColumns=True)

    def step(x: dict[str, np.ndarray]) -> list:
        vocal, mix = (_Wave(x[c][0], int(x["offset"][0]), int(x["length"][0]), m) for c in ("vocal", "mix"))
        t, end = x["t"][1:], int(x["length"][0]) / m.rate
        guard = [vocal.quieter(vocal.crossing(v)) for v in t.tolist()]
        final = [min(max(mix.quieter(mix.crossing(v)), 0.0), end) for v in guard]
        return [x["track"][1:], x["point"][1:], t, x["score"][1:], np.array(guard), np.array(final), np.full(len(t), end)]

    return fold(both, ["track", "chunk"], ["part", "point"], step, "track bigint, point bigint, t double, score double, guard double, final double, duration double")


def finalise(points: DataFrame, chunks: DataFrame, size: int, m: Moves, gap: float, edge: float, topk: int | None = None, per_window: int | None = None, window: float = 10.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boundaries (track, sample, score; both ends and the final cuts, each once), adjustments of the final cuts (track, cut, raw, guard, final, score,
    guard_shift_ms, final_shift_ms) and suppressed points, of points (track, point, t, score).

    Points are thinned by score and distance, moved, and those near an end (edge, or half a short track) or too near the last one kept go. A final cut has score 1; its
    adjustment is the one that ends nearest to it."""
    kept = suppress(points.withColumnRenamed("point", "cand_id"), gap, topk, per_window, window).withColumnRenamed("cand_id", "point")
    suppressed = points.join(kept.select("track", "point"), ["track", "point"], "left_anti")
    steps = moved(kept, chunks, size, m)
    margin = F.least(F.lit(edge), F.col("duration") / 2)
    inner = steps.where((F.col("final") > margin) & (F.col("final") < F.col("duration") - margin))
    cuts = greedy_gap(inner.select("track", F.col("final").alias("t")), gap)
    found = nearest_adjustment(cuts, steps.select("track", "final", F.col("t").alias("raw"), F.col("t").alias("n")))
    own = steps.groupBy("track", "final").agg(F.min_by(F.struct("guard", "score"), "t").alias("_o"))
    adjusted = found.join(own, ["track", "final"]).select(
        "track", F.col("t").alias("cut"), "raw", F.col("_o.guard").alias("guard"), "final", F.col("_o.score").alias("score"), ((F.col("_o.guard") - F.col("raw")) * 1000).alias("guard_shift_ms"), ((F.col("final") - F.col("raw")) * 1000).alias("final_shift_ms")
    )
    ends = chunks.groupBy("track").agg(F.max("length").alias("length")).select("track", F.explode(F.array(F.lit(0).cast("bigint"), "length")).alias("sample"))
    at = cuts.select("track", F.rint(F.col("t") * m.rate).cast("bigint").alias("sample"))
    boundaries = ends.unionByName(at).distinct().withColumn("score", F.lit(1.0))
    return boundaries, adjusted, suppressed
