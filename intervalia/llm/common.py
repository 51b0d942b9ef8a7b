"""Helpers that the corpus operators share: table access, shared work tables, Arrow text buffers."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python task turns into numpy arrays at once; bounds its memory.
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where that is unset and all runs in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="intervalia-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Work tables in the shared folder. They cut lineage, survive lost executors, and go at exit or on drop()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._clear)

    def path(self) -> str:
        self._n += 1
        return f"{self.base}/{self._n}"

    def remove(self, path: str) -> None:
        remove(self.spark, path)

    def write(self, df: DataFrame, codec: str = "snappy") -> DataFrame:
        path = self.path()
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._work_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "_work_path", None):
            remove(self.spark, path)

    def _clear(self) -> None:
        try:
            remove(self.spark, self.base)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            pass


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and where each row starts (one more than rows); null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most`` bytes of text; a longer text is a piece of its own."""
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text)
        _, offsets = utf8(batch.column(at))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def fresh(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
