"""Work on groups of rows that share a key, one bounded group at a time.

Rows are hash-partitioned and sorted by key, and a Python worker reads each key's rows as a run. A run of more than
``limit`` rows isn't worked on: its rows come back, are dealt at random into blocks of about limit rows, and each pair of blocks
becomes a group of its own. So every pair of rows of a key still meets in some group, and no task holds more than a
few blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch


def _stream(worker: Callable, keys: list[str], limit: int | None, schema_in: T.StructType, out: list[str]):
    """worker(columns by name, bounds of runs) gives the output columns."""
    names = schema_in.names

    def joined(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        return {n: np.concatenate([p.column(i).to_numpy() for p in parts]) for i, n in enumerate(names)}

    def edges(columns: dict[str, np.ndarray]) -> np.ndarray:
        n = len(columns[keys[0]])
        new = np.ones(n, bool)
        new[1:] = np.any([columns[k][1:] != columns[k][:-1] for k in keys], axis=0)
        return np.append(np.flatnonzero(new), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, hot = 0, None

        def result(columns: dict[str, np.ndarray], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
            sizes = np.diff(bounds)
            many = sizes > limit if limit else np.zeros(len(sizes), bool)
            if many.any():
                yield hot_rows({n: c[np.repeat(many, sizes)] for n, c in columns.items()})
                keep = np.repeat(~many, sizes)
                columns, bounds = {n: c[keep] for n, c in columns.items()}, np.append(0, np.cumsum(sizes[~many]))
            made = worker(columns, bounds)
            n = len(made[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, bool)), *map(pa.array, made), *(pa.nulls(n, pa.int64()) for _ in names)], names=["hot", *out, *(f"in_{x}" for x in names)])

        def hot_rows(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
            n = len(columns[names[0]])
            return pa.RecordBatch.from_arrays([pa.array(np.ones(n, bool)), *(pa.nulls(n, pa.int64()) for _ in out), *(pa.array(columns[x]) for x in names)], names=["hot", *out, *(f"in_{x}" for x in names)])

        for batch in batches:
            if not batch.num_rows:
                continue
            if hot is not None:  # the rest of a run that is known to be too long
                columns = joined([batch])
                same = np.all([columns[k] == v for k, v in zip(keys, hot)], axis=0)
                end = len(same) if same.all() else int(np.argmin(same))
                if end:
                    yield hot_rows({n: c[:end] for n, c in columns.items()})
                if end == batch.num_rows:
                    continue
                batch, hot = batch.slice(end), None
            held.append(batch)
            rows += batch.num_rows
            if rows < 20_000:
                continue
            columns = joined(held)
            bounds = edges(columns)
            last = bounds[-2]
            if last:
                yield from result({n: c[:last] for n, c in columns.items()}, bounds[:-1])
            rest = {n: c[last:] for n, c in columns.items()}
            rows = len(rest[names[0]])
            if limit and rows > limit:
                yield hot_rows(rest)
                hot, held, rows = [rest[k][0] for k in keys], [], 0
            else:
                held = [pa.RecordBatch.from_arrays([pa.array(rest[n]) for n in names], names=names)]
        if held:
            columns = joined(held)
            yield from result(columns, edges(columns))

    return run


def by_runs(rows: DataFrame, keys: list[str], worker: Callable, out: list[str], scratch: Scratch, limit: int, order: list[str] = []) -> DataFrame:
    """All of worker's output rows; rows and output hold whole numbers (bigint) without nulls only."""
    names = rows.columns
    schema = T.StructType([T.StructField("hot", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in [*out, *(f"in_{x}" for x in names)])])
    first = scratch.write(rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(_stream(worker, keys, limit, rows.schema, out), schema))
    made = first.where("not hot").select(*out)
    again = first.where("hot").select(*(F.col(f"in_{n}").alias(n) for n in names))
    if again.isEmpty():
        return made
    sizes = again.groupBy(*keys).agg(F.ceil(F.count("*") / limit).cast("bigint").alias("_blocks"))
    block = F.pmod(F.xxhash64(*names), F.col("_blocks"))
    dealt = (
        again.join(sizes, keys)
        .withColumn("_own", block)
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
        .withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")})
        .select(*names, "_i", "_j")
    )
    more = [*keys, "_i", "_j"]
    inner = _stream(worker, more, None, dealt.schema, out)
    schema2 = T.StructType([*schema.fields, T.StructField("in__i", T.LongType()), T.StructField("in__j", T.LongType())])
    second = dealt.repartition(*more).sortWithinPartitions(*more, *order).mapInArrow(inner, schema2).select(*out)
    return made.unionByName(scratch.write(second))
