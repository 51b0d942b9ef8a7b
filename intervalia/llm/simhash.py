"""Operator 6, SimHash near-dedup by covering locality-sensitive hashing.

Each text gets a 64-bit fingerprint of its 4-word shingles. Equal fingerprints collapse before any comparison, so a group of
copies is one row. Every bit position i has a 5-bit vector m(i); table v of the 31 tables keeps the bits with an odd product
of m(i) and v. Any 4 positions leave some v whose products with all of them are even, so every pair at 4 or fewer differing bits
agrees on all kept bits of some table: no link is lost. Within a bucket only a spanning forest of the links is written, never all
pairs, and buckets over LIMIT rows are worked on block by block (runs.py).

Edge cases: a text without words (null, empty) has fingerprint zero and is linked like any other. Repeated rows share their
doc_id's component. Rows with a null doc_id are linked too, but don't name a component. An empty table gives no rows. Extra columns
are left out of the result, except in stage().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, table
from .components import components
from .runs import by_runs

RADIUS, WORDS, SEED = 4, 4, 42
LIMIT = 16_384
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None) -> int:
    """As a signed 64-bit number; its bit is 1 if set in over half the shingles' hashes."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    own, hashed = words[:WORDS], xxhash.xxh64_intdigest
    shingles = zip(*(words[k:] for k in range(WORDS))) if len(words) >= WORDS else [own]
    hashes = np.array([hashed(b" ".join(s), SEED) for s in shingles], "<u8")
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keys: list[str] = []) -> DataFrame:
    """doc_id, fp and keys, further columns of whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            fps = [fingerprint(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64()), *(batch.column(k) for k in keys)], names=["doc_id", "fp", *keys])

    return docs.select("doc_id", text, *keys).mapInArrow(run, ", ".join(f"{c} bigint" for c in ["doc_id", "fp", *keys]))


def masks(bits: int = 64, radius: int = RADIUS) -> list[int]:
    """The kept bits of every table, as signed numbers."""
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(bits)]
    kept = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
    return [m - (1 << bits) if m >> (bits - 1) else m for m in kept]


def linked(columns: dict[str, np.ndarray], bounds: np.ndarray) -> list[np.ndarray]:
    """A spanning forest of the links within each run."""
    fps, sizes = columns["fp"].view(np.uint64), np.diff(bounds)  # unsigned, as bits of negative numbers count otherwise
    two = bounds[:-1][sizes == 2]
    close = np.bitwise_count(fps[two] ^ fps[two + 1]) <= RADIUS
    a, b = [fps[two][close]], [fps[two + 1][close]]
    for start, size in zip(bounds[:-1][sizes > 2], sizes[sizes > 2]):
        rest = np.unique(fps[start : start + size])
        while len(rest):
            reached, rest = [rest[0]], rest[1:]
            while reached and len(rest):
                at = reached.pop()
                near = np.bitwise_count(rest ^ at) <= RADIUS
                if near.any():
                    found, rest = rest[near], rest[~near]
                    a.append(np.full(len(found), at, np.uint64))
                    b.append(found)
                    reached += list(found)
    return [np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)]


def near_duplicates(docs: DataFrame, text: str = "text", keys: list[str] = []) -> DataFrame:
    """doc_id, fp, keys, root, and component_id, the smallest doc_id reachable over links."""
    scratch = Scratch(docs.sparkSession, "simhash")
    each = scratch.write(fingerprints(docs, text, keys))
    distinct = scratch.write(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    tables = F.explode(F.array(*(F.struct(F.lit(k).cast("bigint").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks()))))
    buckets = distinct.select(tables.alias("x"), "fp").select("x.t", "x.key", "fp")
    forest = by_runs(buckets, ["t", "key"], linked, ["a", "b"], scratch, LIMIT)
    roots = components(forest, scratch)
    rooted = scratch.write(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return each.join(rooted.join(names, "root").select("fp", "component_id", "root"), "fp").select("doc_id", "fp", "component_id", "root", *keys)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id (null comes last), then the smallest hash of its text; of
    rows equal in doc_id and text one."""
    th = F.xxhash64("text")
    found = near_duplicates(docs.select("doc_id", "text", th.alias("th")), keys=["th"])
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("x")).select(F.col("x.doc_id").alias("kept"), F.col("x.th").alias("of"))
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), th.alias("th"))
    both = whole.join(first, (F.col("th") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("kept")))
    return both.dropDuplicates(["doc_id", "th"]).select("row.*")
