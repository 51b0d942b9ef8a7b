"""Operator 8, quality classifier by compression.

Two zstandard dictionaries are trained on good and on bad labelled texts. A text is compressed with each, block by block
so that the dictionary matters all along a long text, and the difference of the two sizes, divided by the text's bytes, is its only
feature: a logistic curve, fitted on labelled texts that built no dictionary, makes a probability of it. The curve weighs the two labels as
they are among all labelled rows, so scores are calibrated to that share. The dictionaries and the curve are learnt from whole texts, at
most PER_LABEL of a label and none of over TRAIN_BYTES, those with the smallest hash of doc_id; scoring reads every whole text.

Edge cases: null and empty texts have a difference of 0, which the curve scores like any other. With one label missing
every text scores the share of label 1 (0.5 with no labels). Repeated rows are scored one by one. Extra columns pass through;
score replaces an input column of the same name.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table
from .language_id import fold

#: Bound of the labelled sample: texts of each label, and the bytes up to which a text belongs to it.
PER_LABEL, TRAIN_BYTES = 1500, 32_768
DICTIONARY_BYTES, BLOCK_BYTES, LEVEL = 112_640, 1_024, 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float


@functools.lru_cache(maxsize=2)
def _compressors(good: bytes, bad: bytes) -> tuple:
    out = []
    for raw in (good, bad):
        of = zstandard.ZstdCompressionDict(raw)
        of.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=of, write_content_size=False, write_dict_id=False))
    return tuple(out)


def difference(text: str | None, good: bytes, bad: bytes) -> float:
    """Bytes that the good dictionary saves over the bad one, by byte of text."""
    raw = (text or "").encode()
    if not raw or not good:
        return 0.0
    blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
    a, b = (sum(len(c.compress(x)) for x in blocks) for c in _compressors(good, bad))
    return (b - a) / len(raw)


def _dictionary(texts: list[str]) -> bytes:
    """Trained, or where the sample is too small for that, its plain bytes."""
    raw = [t.encode() for t in texts]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [t[i : i + 2000] for t in raw for i in range(0, len(t), 2000)]).as_bytes()
    except zstandard.ZstdError:
        return b"\0" + b"".join(raw)[:DICTIONARY_BYTES]


def _curve(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and intercept of a logistic curve by Newton's steps with a small ridge; label 1 weighs as its share of all labels."""
    scale = x.std() or 1.0
    design = np.column_stack([x / scale, np.ones(len(x))])
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - 0.1 * beta
        beta += np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2), gradient)
    return float(beta[0] / scale), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality") -> Model:
    """docs: doc_id and text; labels: doc_id and label (1 good, 0 bad; others are left out). Null texts are left out.

    The sample is chosen among the labels alone, so that only PER_LABEL ids of a task and the chosen texts are moved."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("label"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    samples = {}
    for value in (1, 0):
        ids = known.where(F.col("label") == value).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_LABEL)
        own = docs.where(F.col(text).isNotNull() & (F.octet_length(text) <= TRAIN_BYTES)).join(F.broadcast(ids), "doc_id")  # PER_LABEL ids
        own = own.groupBy("doc_id").agg(F.min(text).alias("text"))  # one text an id
        samples[value] = [r.text for r in sorted(own.collect(), key=lambda r: r.doc_id)]  # PER_LABEL rows at most
    n1, n0 = len(samples[1]), len(samples[0])
    if not n1 or not n0:
        share = n1 / (n1 + n0) if n1 + n0 else 0.5
        return Model(b"", b"", 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    good, bad = (_dictionary(samples[v][::2]) for v in (1, 0))
    held = [(t, v) for v in (1, 0) for t in (samples[v][1::2] or samples[v])]
    x = np.array([difference(t, good, bad) for t, _ in held])
    return Model(good, bad, *_curve(x, np.array([v for _, v in held], float), counts[1] / (counts[1] + counts[0])))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = docs.drop("score") if text != "score" else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, text):
            x = np.array([difference(t, m.good, m.bad) for t in batch.column(text).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(x * m.slope + m.intercept, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, "score"])

    return keep.mapInArrow(run, T.StructType([*keep.schema.fields, T.StructField("score", T.DoubleType())]))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without an id isn't learnt from, and whether it is held out isn't known: null."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = train(docs.where(fold(3) != 1), labels.where(fold(3) != 1))
    return score(docs, model).select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
