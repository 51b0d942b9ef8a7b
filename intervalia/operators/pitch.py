"""Pitch contours: how unlike a wave is to itself some samples on, for each lag and frame, and the cheapest path of lags through all frames.

A long track's path goes block by block: the costs of passing a block from each lag to each lag are a small matrix; these are chained a track, then all blocks are passed at once
with the costs that enter them, and the path is followed back in the same way. So no group holds more than a block of frames, and the path doesn't depend on the blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold

#: Frames of a block.
SIZE = 1 << 14


@dataclass(frozen=True)
class Lags:
    """Samples a second, samples compared in a frame, samples from one frame to the next, shortest and longest lag."""

    rate: float
    window: int
    hop: int
    least: int
    most: int

    @property
    def halo(self) -> int:
        return self.window + self.most


def unlikeness(chunks: DataFrame, lags: Lags, size: int) -> DataFrame:
    """track, frame, cost: for each lag the squared difference of a frame from the samples so many on, over its mean for all shorter lags; 1 where that is 0.
    chunks: finalise.wave_chunks of this size (a multiple of hop) with samples and this halo. Frames that don't fit in the wave aren't there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = np.arange(1, lags.most + 1)
        for batch in batches:
            for row in range(batch.num_rows):
                track, chunk, offset, length = (batch.column(c)[row].as_py() for c in ("track", "chunk", "offset", "length"))
                s = batch.column("samples")[row].values.to_numpy(zero_copy_only=False).astype(np.float64)
                first, last = -(-chunk * size // lags.hop), min(((chunk + 1) * size - 1) // lags.hop, (length - lags.halo) // lags.hop)
                if last < first:
                    continue
                begin = np.arange(first, last + 1) * lags.hop - offset
                out = np.empty((len(begin), lags.most))
                for lag in k:
                    square = np.concatenate([[0.0], np.cumsum((s[:-lag] - s[lag:]) ** 2)])
                    out[:, lag - 1] = square[begin + lags.window] - square[begin]
                mean = np.cumsum(out, 1) / k
                cost = np.where(mean > 1e-12, out / np.maximum(mean, 1e-12), 1.0)[:, lags.least - 1 :]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cost) + 1, dtype=np.int32) * cost.shape[1]), pa.array(cost.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([track] * len(cost), pa.int64()), pa.array(np.arange(first, last + 1)), lists], names=["track", "frame", "cost"])

    if size % lags.hop:
        raise ValueError("chunks must hold whole hops")
    return chunks.select("track", "chunk", "offset", "length", "samples").mapInArrow(run, "track bigint, frame bigint, cost array<double>")


def _passed(costs: np.ndarray, step: np.ndarray, entering: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Costs of ending in each state, and for each frame and state the state before (the least one on ties); the first frame's are those that entered."""
    best, parents = (costs[0] if entering is None else None), np.zeros(costs.shape, np.int64)
    if entering is not None:
        total = entering[:, None] + step
        parents[0] = total.argmin(0)
        best = total.min(0) + costs[0]
    for f in range(1, len(costs)):
        total = best[:, None] + step
        parents[f] = total.argmin(0)
        best = total.min(0) + costs[f]
    return best, parents


def cheapest_path(costs: DataFrame, step: np.ndarray, size: int = SIZE) -> DataFrame:
    """track, frame, state: the path through costs (track, frame from 0 without gaps, cost: an array with a value for each state) whose costs and steps (from state, to state) add up to the least."""
    n = costs.groupBy("track").agg(F.max("frame").alias("last_frame"))
    own = costs.join(n, "track").select("track", F.expr(f"frame div {size}").alias("block"), "frame", "cost", "last_frame")
    long = own.where(F.col("last_frame") >= size)
    keys = ["track", "block"]

    def maps(x: dict[str, np.ndarray]) -> list:
        c = np.stack(x["cost"])
        whole = np.repeat(c[:1], len(step), 0) if x["block"][0] == 0 else step + c[0]
        for own_cost in c[1:]:
            whole = (whole[:, :, None] + step[None]).min(1) + own_cost
        return [x["track"][:1], x["block"][:1], [whole.tobytes()]]

    def chained(x: dict[str, np.ndarray]) -> list:
        state, states = np.zeros(len(step)), []
        for raw in x["map"]:
            states.append(state.tobytes())
            state = (state[:, None] + np.frombuffer(raw).reshape(step.shape)).min(0)
        return [x["track"], x["block"], states, np.full(len(states), int(state.argmin()))]

    def entered(x: dict[str, np.ndarray]) -> np.ndarray | None:
        return None if x["state"][0] is None or x["block"][0] == 0 else np.frombuffer(x["state"][0])

    def origins(x: dict[str, np.ndarray]) -> list:
        _, parents = _passed(np.stack(x["cost"]), step, entered(x))
        at = np.arange(len(step))
        for p in parents[::-1]:
            at = p[at]
        return [x["track"][:1], x["block"][:1], x["last"][:1], [at.tobytes()]]

    def chosen(x: dict[str, np.ndarray]) -> list:
        at, ends = int(x["last"][0]), []
        for raw in x["origin"]:
            ends.append(at)
            at = int(np.frombuffer(raw, np.int64)[at])
        return [x["track"], x["block"], np.array(ends)]

    def traced(x: dict[str, np.ndarray]) -> list:
        best, parents = _passed(np.stack(x["cost"]), step, entered(x))
        at = int(best.argmin()) if x["state"][0] is None else int(x["end"][0])
        path = np.empty(len(parents), np.int64)
        for f in range(len(parents) - 1, -1, -1):
            path[f] = at
            at = parents[f, at]
        return [x["track"], x["frame"], path]

    states = fold(fold(long, keys, ["frame"], maps, "track bigint, block bigint, map binary"), ["track"], ["block"], chained, "track bigint, block bigint, state binary, last bigint")
    left = fold(long.join(states, keys), keys, ["frame"], origins, "track bigint, block bigint, last bigint, origin binary")
    ends = fold(left, ["track"], [F.col("block").desc()], chosen, "track bigint, block bigint, end bigint")
    return fold(own.join(states.drop("last").join(ends, keys), keys, "left"), keys, ["frame"], traced, "track bigint, frame bigint, state bigint")


def pitch_contour(chunks: DataFrame, lags: Lags, size: int, jump: float = 0.5, voiced: float = 0.3, block: int = SIZE) -> DataFrame:
    """track, frame, lag, hz and voiced (whether the frame is that like itself at the lag): the path of the least unlikeness, with jump for each octave from frame to frame."""
    costs = unlikeness(chunks, lags, size)
    lag = np.arange(lags.least, lags.most + 1)
    path = cheapest_path(costs, jump * np.abs(np.log2(lag[:, None] / lag[None, :])), block)
    x = path.join(costs, ["track", "frame"])
    return x.select("track", "frame", (F.col("state") + lags.least).alias("lag"), (lags.rate / (F.col("state") + lags.least)).alias("hz"), (F.get("cost", F.col("state").cast("int")) < voiced).alias("voiced"))
