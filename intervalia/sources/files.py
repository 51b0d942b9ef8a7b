"""Listings, checksums, keys, and the documents and tables that leave the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a review table, in order. Fixed values.
REVIEW = ("track", "title", "category", "path", "status", "segments", "cuts", "words", "cut_inside_word_rate", "segment_5_15_pass_rate", "naturalness", "note")


def listing(spark: SparkSession, folder: str, suffix: str = "*.{wav,mp3,flac,m4a}") -> DataFrame:
    """path, size and sha256 of the files under folder, by name; contents are read by the tasks, a file at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).orderBy(F.lower("path"))


def listed(spark: SparkSession, manifest: str, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path) that a text file of paths names, and the names that are missing. Blank lines and lines that begin with # don't count."""
    names = spark.read.text(manifest).select(F.trim("value").alias("name")).where("name != '' and not startswith(name, '#')").distinct()
    base = lambda c: F.regexp_extract(c, "([^/]+)$", 1)
    same = (base("path") == base("name")) & F.col("path").endswith(F.col("name"))
    return files.join(names, same, "left_semi"), names.join(files, same, "left_anti")


def canonical(*columns: str) -> Column:
    """JSON of the columns in the order of their names, nulls included."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def cache_key(*columns: str, prefix: str = "lyrics:") -> Column:
    """The same key for the same values, whatever the order in which columns are named."""
    return F.concat(F.lit(prefix), F.sha2(canonical(*columns), 256))


def relative(path: Column, base: str) -> Column:
    """path below base, else path itself; null stays null."""
    root = base.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)


def request(track: str = "track", duration: str = "duration", **options: str) -> Column:
    """The request document of a track for an outside recogniser."""
    return F.to_json(F.struct(F.col(duration).alias("duration_s"), *(F.lit(v).alias(k) for k, v in sorted(options.items())), F.col(track).alias("track")))


def review(rows: DataFrame) -> DataFrame:
    """The review table: its columns in order, those that rows lacks and nulls as empty strings."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    return rows.select(*(text(c).alias(c) for c in REVIEW))


def write_review(rows: DataFrame, path: str) -> None:
    review(rows).write.option("header", True).option("emptyValue", "").csv(path)


def write_candidates(candidates: DataFrame, path: str) -> None:
    """A document a track: {"track": ..., "candidates": [...]}, in order of time."""
    own = F.struct("t", *(c for c in candidates.columns if c not in ("track", "t")))
    candidates.groupBy("track").agg(F.array_sort(F.collect_list(own)).alias("candidates")).write.json(path)


def write_manifests(manifests: DataFrame, path: str) -> None:
    manifests.write.json(path)
