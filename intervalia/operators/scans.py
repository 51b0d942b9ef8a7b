"""Scans with a state, block by block: what a block makes of each state that may enter it is a table; the tables of a track are chained, and then all blocks run at once, each from the state that
enters it. So a long track isn't one group, and the result doesn't depend on the blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold

#: A state is a tuple of numbers. A run gets a block's columns and the state that enters, and gives that which leaves and the output columns.
State = tuple[float, ...]
Run = Callable[[dict[str, np.ndarray], State], tuple[State, list]]
SIZE = 1 << 12


def scan(rows: DataFrame, order: str, start: State, states: Callable[[dict[str, np.ndarray]], list[State]], run: Run, schema: str, size: int = SIZE) -> DataFrame:
    """run over each track's rows (track; order: a column of whole numbers from 0), from start on. states gives those that may enter a block as far as they
    make a difference to it; one that isn't listed stands for the one with the same first number and -inf for the others."""
    keys = ["track", "block"]
    blocks = rows.withColumn("block", F.expr(f"{order} div {size}"))
    last = rows.groupBy("track").agg(F.max(order).alias("_last")).where(F.col("_last") >= size).select("track")
    long = blocks.join(last, "track", "left_semi")
    width = len(start)

    def tables(x: dict[str, np.ndarray]) -> list:
        own = [start] if x["block"][0] == 0 else states(x)
        leaving = [run(x, s)[0] for s in own]
        return [x["track"][:1], x["block"][:1], [np.array(own, np.float64).tobytes()], [np.array(leaving, np.float64).tobytes()]]

    def chained(x: dict[str, np.ndarray]) -> list:
        state, entering = start, []
        for own, leaving in zip(x["own"], x["leaving"]):
            entering.append(np.array(state, np.float64).tobytes())
            table = dict(zip(map(tuple, np.frombuffer(own).reshape(-1, width).tolist()), map(tuple, np.frombuffer(leaving).reshape(-1, width).tolist())))
            state = table[state] if state in table else table[(state[0], *[-np.inf] * (width - 1))]
        return [x["track"], x["block"], entering]

    def through(x: dict[str, np.ndarray]) -> list:
        return run(x, start if x["entering"][0] is None else tuple(np.frombuffer(x["entering"][0]).tolist()))[1]

    entering = fold(fold(long, keys, [order], tables, "track bigint, block bigint, own binary, leaving binary"), ["track"], ["block"], chained, "track bigint, block bigint, entering binary")
    return fold(blocks.join(entering, keys, "left"), keys, [order], through, schema)


def affine(rows: DataFrame, order: str, size: int = SIZE) -> DataFrame:
    """track, order and y, with y = a * (the y before, 0 at first) + b, of rows (track, order from 0, a, b). A block is itself such a step, so blocks chain as their rows do."""
    keys = ["track", "block"]
    blocks = rows.select("track", order, "a", "b", F.expr(f"{order} div {size}").alias("block"))
    last = rows.groupBy("track").agg(F.max(order).alias("_last")).where(F.col("_last") >= size).select("track")

    def whole(x: dict[str, np.ndarray]) -> list:
        a, b = 1.0, 0.0
        for own_a, own_b in zip(x["a"].tolist(), x["b"].tolist()):
            a, b = own_a * a, own_a * b + own_b
        return [x["track"][:1], x["block"][:1], np.array([a]), np.array([b])]

    def through(x: dict[str, np.ndarray]) -> list[float]:
        y, out = 0.0 if np.isnan(x["entering"][0]) else float(x["entering"][0]), []
        for a, b in zip(x["a"].tolist(), x["b"].tolist()):
            y = a * y + b
            out.append(y)
        return out

    def entered(x: dict[str, np.ndarray]) -> list:
        y = 0.0
        out = []
        for a, b in zip(x["a"].tolist(), x["b"].tolist()):
            out.append(y)
            y = a * y + b
        return [x["track"], x["block"], np.array(out)]

    steps = fold(blocks.join(last, "track", "left_semi"), keys, [order], whole, "track bigint, block bigint, a double, b double")
    entering = fold(steps, ["track"], ["block"], entered, "track bigint, block bigint, entering double")
    return fold(blocks.join(entering, keys, "left"), keys, [order], lambda x: [x["track"], x[order], np.array(through(x))], f"track bigint, {order} bigint, y double")
