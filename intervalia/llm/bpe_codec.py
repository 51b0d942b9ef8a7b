"""Operator 10, byte-level BPE encoding and decoding, by prefix dynamic programming (see bpe.py).

Texts are cut by the public pattern; each piece is encoded separately, a piece that is itself a token as that token.
The job is one map over rows: no shuffle, the vocabulary file (its size is fixed by the tokenizer) goes to the tasks as a
broadcast, and of a worker's memo of pieces the older half goes at a fixed size.

Edge cases: a null or empty text has no tokens, and both digests are those of empty input. Repeated rows are encoded
one by one. Extra columns pass through; ids and n_tokens replace input columns of the same name.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Bpe, Prefixes, tiktoken_ranks
from .common import slices, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces in each of the two halves of a worker's memo; the older half goes when the newer one is full.
MEMO = 200_000


def vocabulary_file(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    def __init__(self, raw: bytes, pattern: str):
        self.bpe = Bpe(tiktoken_ranks(raw))
        self.pattern = regex.compile(pattern)
        self.pieces: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}
        self.bytes_of = {i: t for t, i in self.bpe.ids.items()}

    def piece(self, piece: str) -> tuple[str, bytes]:
        """Decimal ids joined by commas, and the bytes that these ids decode to."""
        if (known := self.older.get(piece)) is None:
            raw = piece.encode()
            ids = [self.bpe.ids[raw]] if raw in self.bpe.ids else Prefixes(self.bpe, raw).ids()
            known = ",".join(map(str, ids)), self.decode(ids)
        return known

    def code(self, text: str) -> tuple[str, bytes]:
        """The same of a whole text."""
        known = self.pieces
        pieces = self.pattern.findall(text)
        try:
            parts = [known[p] for p in pieces]
        except KeyError:
            parts = []
            for p in pieces:
                if (part := known.get(p)) is None:
                    part = self.piece(p)
                    if len(known) >= MEMO:
                        self.older, self.pieces = known, {}
                        known = self.pieces
                    known[p] = part
                parts.append(part)
        return ",".join([x[0] for x in parts]), b"".join([x[1] for x in parts])

    def decode(self, ids: list[int]) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids])


@functools.lru_cache(maxsize=2)
def codec(raw: bytes, pattern: str) -> Codec:
    return Codec(raw, pattern)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, text: str = "text", vocabulary: str | None = None, digests: bool = False) -> DataFrame:
    """docs with ids (array of int) and n_tokens, or with digests instead of the ids: ids_sha256 and decoded_sha256."""
    spark = docs.sparkSession
    raw, pattern = spark.sparkContext.broadcast(_read(vocabulary or vocabulary_file())), _pattern()
    new = [T.StructField("n_tokens", T.LongType())]
    new += [T.StructField(n, T.StringType()) for n in ("ids_sha256", "decoded_sha256")] if digests else [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    keep = docs.drop(*(f.name for f in new if f.name != text))
    schema = T.StructType([*keep.schema.fields, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(raw.value, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in slices(batches, text):
            ids, decoded = zip(*(c.code(t or "") for t in batch.column(text).to_pylist()))
            columns = [*batch.columns, pa.array([i.count(",") + 1 if i else 0 for i in ids], pa.int64())]
            if digests:
                columns += [pa.array([sha(i.encode()) for i in ids], pa.string()), pa.array([sha(d) for d in decoded], pa.string())]
            else:
                columns.append(pa.array([list(map(int, i.split(","))) if i else [] for i in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *(f.name for f in new)])

    return keep.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """encoded with decoded (binary); null ids give null."""
    raw, pattern = encoded.sparkSession.sparkContext.broadcast(_read(vocabulary or vocabulary_file())), _pattern()
    keep = encoded.drop("decoded")
    schema = T.StructType([*keep.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(raw.value, pattern)
        for batch in batches:
            out = [None if x is None else c.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return keep.mapInArrow(run, schema)


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids; the last stage, so it may add columns."""
    return encode(docs).withColumn("ids_sha256", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256))
