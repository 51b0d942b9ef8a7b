"""Session helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> SparkSession:
    """Python workers on a path that holds this package; on a cluster it is installed or sent with --py-files."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return sound(spark)


def sound(spark: SparkSession) -> SparkSession:
    """Without the rule that a union is dealt like its parts: where adaptive execution joins small partitions of one part otherwise than the other's, windows, groups and joins above the
    union would miss rows that belong together (seen in Spark 4.1.2). Sessions that use the operators on their own should set it too."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


@contextmanager
def shuffled_by(spark: SparkSession, partitions: int) -> Iterator[None]:
    """Queries that start inside are dealt to so many partitions, at most to the session's own number."""
    name = "spark.sql.shuffle.partitions"
    own = spark.conf.get(name)
    spark.conf.set(name, min(int(own), partitions))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in that of spark.checkpoint.dir, which the driver and all executors share; a local one only where that is unset and all runs in one process, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="intervalia-")
        spark.conf.set("spark.checkpoint.dir", shared)
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows as a work table, for what reads them many times: each reading would compute them anew."""
    folder = work_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
