"""Steps that depend on the steps before them, over sorted groups: rows are dealt by key, sorted by Spark, and read as a stream.

A task holds one group and one batch at a time, whatever the number of groups, and small groups cost no call of their own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: One group's columns by name; lists of output columns come back.
Step = Callable[[dict[str, np.ndarray]], list]
#: Stands for null in columns of whole numbers, which stay exact.
NONE = np.iinfo(np.int64).min


def fold(rows: DataFrame, keys: list[str], order: list, step: Step, schema: str, error: str | None = None) -> DataFrame:
    """step over each group of rows with equal keys, sorted by order; the groups' outputs together. Null floats come as NaN, null whole numbers as NONE, and go out as null again.

    With error, the name of one more column of text, a group whose step raises becomes one row: its keys, where the output has columns of their
    names, and what was raised. The others have null there, and go on. Without it the job fails."""
    out = T._parse_datatype_string(schema)
    if error:
        out = T.StructType([*out.fields, T.StructField(error, T.StringType())])
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(out)

        def failed(group: dict[str, np.ndarray], raised: Exception) -> list:
            key = {k: group[k][:1] for k in keys}
            none = {k: v[0] is None or v[0] == NONE for k, v in key.items()}
            return [[None if none[f.name] else key[f.name][0]] if f.name in key else [f"{type(raised).__name__}: {raised}" if f.name == error else None] for f in kinds]

        def done(parts: list[pa.RecordBatch], edge: np.ndarray) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts)
            columns = {n: _plain(table[n]) for n in names}
            made: list[list] = [[] for _ in kinds]
            for lo, hi in zip(edge[:-1], edge[1:]):
                group = {n: c[lo:hi] for n, c in columns.items()}
                try:
                    lists = step(group)
                    lists = [*lists, [None] * len(lists[0])] if error else lists
                except Exception as raised:  # noqa: BLE001  it is given out as a row
                    if not error:
                        raise
                    lists = failed(group, raised)
                for to, column in zip(made, lists):
                    to.append(column)
            if made[0]:
                flat = [np.concatenate(m) if all(isinstance(part, np.ndarray) for part in m) else [v for part in m for v in part] for m in made]
                yield pa.RecordBatch.from_arrays([_column(c, f.type) for c, f in zip(flat, kinds)], schema=kinds)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            start = _starts(batch, held[-1] if held else None, keys)
            if len(start):  # what is held, with the rows before the first start, and the groups before the last start are whole
                before = sum(b.num_rows for b in held)
                edge = np.concatenate([[0], before + start]) if before else start  # a first row starts a group
                if len(edge) > 1:
                    yield from done([*held, batch.slice(0, start[-1])], edge)
                held = [batch.slice(start[-1])]
            else:
                held.append(batch)
        if held:
            yield from done(held, np.array([0, sum(b.num_rows for b in held)]))

    # Dealt by the keys themselves, rows that a join has dealt so already wouldn't be dealt again; where adaptive execution then makes that join a broadcast, it reads them as they lie, and groups fall apart.
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, out)


def _plain(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if pa.types.is_integer(column.type) and column.null_count:
        column = column.cast(pa.int64()).fill_null(NONE)
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def _column(values: np.ndarray | list, kind: pa.DataType) -> pa.Array:
    if isinstance(values, np.ndarray) and values.dtype == np.int64 and pa.types.is_integer(kind):
        return pa.array(values, kind, mask=values == NONE)
    if pa.types.is_integer(kind) and not isinstance(values, np.ndarray):
        values = [None if v == NONE else v for v in values]
    return pa.array(values, kind, from_pandas=True)


def _starts(batch: pa.RecordBatch, before: pa.RecordBatch | None, keys: list[str]) -> np.ndarray:
    """Where a group starts in the batch; not at its first row if that goes on with the group before."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = before is None
    for k in keys:
        c = _plain(batch.column(k))
        new[1:] |= c[1:] != c[:-1]
        if before is not None:
            new[0] |= c[0] != _plain(before.column(k).slice(before.num_rows - 1))[0]
    return np.flatnonzero(new)
