"""Operator 3, language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of all labelled rows per task in numpy; a task sends at most languages x features sums, which
Spark adds up. The matrix of log probabilities has a fixed size (features x languages, 1 MB for four languages) and goes to
the scoring tasks as a broadcast. Scoring hashes the n-grams of a slice of texts at once and adds the matrix rows of each
text, never text by text. N-grams are taken of the lower-cased text with runs of non-letters as one space, so that marks and
digits say nothing.

Edge cases: a null text, or one without a letter, is "und" with score 0. Rows without a language are scored but
not learnt from. With no labelled row at all every text is "und". Ties go to the language that sorts first. Repeated
rows each count. Extra columns pass through; lang_pred and score replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, slices, table


@dataclass(frozen=True)
class NGrams:
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 15
    smoothing: float = 0.5

    @property
    def features(self) -> int:
        return 1 << self.bits

    def hashed(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order: the feature of each n-gram, and where each text's begin (one more than texts)."""
        # A space on both sides keeps n-grams inside their text.
        joined = [f" {(t or '').lower()} " for t in texts]
        lengths = np.array([len(t) for t in joined])
        points = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = is_letter()[points]
        points = np.where(letter, points, 32)
        owner = np.repeat(np.arange(len(texts)), lengths)
        # Of a run of blanks the first stays, at a text's begin too; a text without letters has no features.
        keep = letter | np.append(True, (owner[1:] != owner[:-1]) | letter[:-1])[: len(letter)]
        keep &= (np.bincount(owner, letter, len(texts)) > 0)[owner]
        points, owner = points[keep].astype(np.uint64), owner[keep]
        edge = np.searchsorted(owner, np.arange(len(texts) + 1))
        value = np.zeros(len(points), np.uint64)
        for order in range(1, max(self.orders) + 1):
            n = len(points) - order + 1
            if n <= 0:
                return
            value = value[:n] * np.uint64(0x9E3779B97F4A7C15) + points[order - 1 :] + np.uint64(order)
            if order in self.orders:
                feature = ((value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)
                own = owner[:n] == owner[order - 1 :]
                yield feature[own], np.searchsorted(owner[:n][own], np.arange(len(texts) + 1))


_letters = None


def is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.zeros(0x110000, bool)
        _letters[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return _letters


def train(docs: DataFrame, ngrams: NGrams = NGrams(), text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log probabilities by feature and language, prior in the last row."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, text):
            langs = np.array(batch.column(lang).to_pylist(), object)
            texts = np.array(batch.column(text).to_pylist(), object)
            for name in set(langs):
                own = sums.setdefault(name, np.zeros(ngrams.features + 1, np.int64))
                mine = texts[langs == name]
                own[-1] += len(mine)
                for feature, _ in ngrams.hashed(list(mine)):
                    own[:-1] += np.bincount(feature, minlength=ngrams.features)
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "feature", "n"])

    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias(lang), text)
    total = labelled.mapInArrow(partial, "lang string, feature int, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    found = total.toArrow()  # at most languages x features rows
    langs = sorted(set(found["lang"].to_pylist()))
    counts = np.zeros((ngrams.features + 1, len(langs)))
    counts[found["feature"].to_numpy(), np.searchsorted(np.array(langs, object), np.array(found["lang"].to_pylist(), object)) if langs else []] = found["n"].to_numpy()
    features = counts[:-1] + ngrams.smoothing
    return langs, np.vstack([np.log(features / features.sum(0)), np.log(np.maximum(counts[-1:], 1) / max(counts[-1].sum(), 1))]).astype(np.float32)


def identify(docs: DataFrame, langs: list[str], model: np.ndarray, ngrams: NGrams = NGrams(), text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the posterior probability of that language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    keep = docs.drop(*(f.name for f in new if f.name != text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE_BYTES // 2):
            texts = batch.column(text).to_pylist()
            logs = np.tile(shared.value[-1].astype(np.float64), (len(texts), 1))
            seen = np.zeros(len(texts), np.int64)
            for feature, edge in ngrams.hashed(texts):
                for k in range(len(langs)):
                    summed = np.concatenate([[0.0], np.cumsum(shared.value[feature, k], dtype=np.float64)])
                    logs[:, k] += summed[edge[1:]] - summed[edge[:-1]]
                seen += np.diff(edge)
            known = np.array([any(map(str.isalpha, t or "")) for t in texts], bool) & (len(langs) > 0)
            best = logs.argmax(1) if langs else np.zeros(len(texts), int)
            score = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1) if langs else np.zeros(len(texts))
            named = [langs[b] if k else "und" for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(named, pa.string()), pa.array(np.where(known, score, 0.0))], names=[*batch.schema.names, "lang_pred", "score"])

    return keep.mapInArrow(run, T.StructType([*keep.schema.fields, *new]))


def fold(of: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without an id isn't learnt from, and whether it is held out isn't known: null."""
    docs = table(spark, sf_dir, "documents")
    langs, model = train(docs.where(fold(4) != 2))
    return identify(docs.select("doc_id", "text"), langs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")
