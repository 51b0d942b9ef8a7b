"""Operator 5, benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages, twice as long as the shortest benchmark item of their size class and a quarter of
that apart. A passage's vector has sqrt(tf) * idf for each word, idf being taken from counts over all documents. A leak's longest common subsequence with an item covers COVERED_WITH_ANSWER of
the item's words at least, so passages whose surroundings don't share so many words (each as often as both have it) with any item of their class are left out first; no leak is among them. The randomised
SVD of the rest and of the items (a subspace iteration whose products are summed by Spark) gives a latent space; items with a latent cosine of LATENT_COSINE or more to a passage are its candidates, and no other item
is compared with it. A candidate is a leak if the longest common subsequence with the passage and its surroundings covers 80 % of the item's words, or 60 % with nine tenths of its
answer, which is its last sentence.

The benchmark is the stated query set: it is taken in blocks of ITEMS items, so what is broadcast is bounded however
large it grows. Edge cases: null and empty texts, and items without words, match nothing. Items of under MIN_WORDS words (class 0) match
their words in a row only. Longer ones are compared whole, however long. Items without an id are judged like others, and found as null. Repeated rows are judged one by one. Extra columns are left out of the result, except in stage().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, table, utf8
from .words import word_hashes

ITEMS, MIN_WORDS = 4096, 8
BUCKETS = 1 << 16
#: An item of 60 % of whose words a passage twice as long is made has a TF-IDF cosine of 0.42 with it at equal weights.
LATENT_COSINE, RANK, ROUNDS = 0.3, 64, 2
#: Of the words that an item must share, the part that isn't looked for; its commonest words, which are nearly everywhere.
FREE = 0.7
COVERED, COVERED_WITH_ANSWER, ANSWER_COVERED = 0.8, 0.6, 0.9
#: Words of a block of the sums that tasks send, and groups in which these are added first.
_BLOCK, _SALTS = 256, 256


@dataclass
class Queries:
    """A block of items: ids, words as places in vocabulary, the same of their answers, and the size class of each."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    classes: np.ndarray
    vocabulary: np.ndarray
    weights: np.ndarray

    def __post_init__(self) -> None:
        """For sharing(): least[k] words must be shared with item k. Its most frequent words, up to a FREE part of that, are taken as shared,
        and least_rare[k] of the others must be found; rare_item from rare_begin[w] on are the items that have w among the others."""
        self.least = np.array([int(np.ceil(COVERED_WITH_ANSWER * len(w) - 1e-9)) for w in self.words], np.int64)
        self.least_rare = self.least.copy()
        pairs, self.tf = [], []
        for k, words in enumerate(self.words):
            w, n = np.unique(words, return_counts=True)
            self.tf.append((w, n))
            order = np.argsort(self.weights[w], kind="stable")
            free = np.cumsum(n[order]) <= int(FREE * self.least[k])
            self.least_rare[k] -= n[order][free].sum()
            pairs += [(x, k) for x in w[order][~free].tolist()]
        pairs.sort()
        self.rare_item = np.array([k for _, k in pairs], np.int64)
        self.rare_begin = np.searchsorted(np.array([x for x, _ in pairs], np.int64), np.arange(len(self.vocabulary) + 1))

    def sharing(self, place: np.ndarray, hits: np.ndarray, lo: np.ndarray, hi: np.ndarray, kind: int) -> np.ndarray:
        """Windows place[lo[i]:hi[i]] (both rising) that have least words in common with an item of this class. hits: where place has a word."""
        w = place[hits]
        n = self.rare_begin[w + 1] - self.rare_begin[w]
        to = self.rare_item[np.repeat(self.rare_begin[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        at = np.repeat(hits, n)
        own = self.classes[to] == kind
        to, at = to[own], at[own]
        order = np.argsort(to, kind="stable")
        to, at = to[order], at[order]
        windows, items = [], []
        edge = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to)) if len(to) else np.zeros(1, np.int64)
        for a, b in zip(edge[:-1], edge[1:]):
            k, some = int(to[a]), at[a:b]
            need = int(self.least_rare[k])
            if len(some) < need:
                continue
            close = np.flatnonzero(some[need - 1 :] - some[: len(some) - need + 1] < 3 << kind)  # need of its words within one window
            if not len(close):
                continue
            first, last = some[close], some[close + need - 1]
            i, j = np.searchsorted(hi, last, side="right"), np.searchsorted(lo, first, side="right")  # windows i to j hold them all
            m = np.maximum(j - i, 0)
            found = np.unique(np.repeat(i - (np.cumsum(m) - m), m) + np.arange(m.sum()))
            if len(found):
                windows.append(found)
                items.append(np.full(len(found), k))
        if not windows:
            return np.zeros(0, np.int64)
        windows, items = np.concatenate(windows), np.concatenate(items)
        good = np.array([self.shared(k, place[lo[i] : hi[i]]) >= self.least[k] for i, k in zip(windows, items)], bool)
        return np.unique(windows[good])

    def shared(self, k: int, around: np.ndarray) -> int:
        """Words that item k and these have in common, each as often as both have it."""
        w, n = self.tf[k]
        around = np.sort(around)
        return int(np.minimum(n, np.searchsorted(around, w, side="right") - np.searchsorted(around, w)).sum())


def counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often words of each bucket occur in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, text):
            hashes, _, _ = word_hashes(*utf8(batch.column(text)), lower=True)
            total += np.bincount((hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    found = docs.select(text).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    out = np.zeros(BUCKETS, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]), lower=True)[0]


def answer_of(text: str) -> str:
    """The last sentence; the last eight words where it has under three."""
    body = text.rstrip()
    at = max(body.rfind(c, 0, max(0, len(body) - 1)) for c in ".!?\n")
    tail = body[at + 1 :]
    return tail if len(tail.split()) >= 3 else " ".join(body.split()[-8:])


def _queries(rows: list, idf: np.ndarray) -> Queries:
    ids, words, answers = [], [], []
    for row in rows:
        own = _hashes(row.text or "")
        if len(own):
            ids.append(row.item_id)
            words.append(own)
            answers.append(_hashes(answer_of(row.text)))
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *words, *answers]))
    place = lambda lists: [np.searchsorted(vocabulary, w) for w in lists]
    weights = idf[(vocabulary % np.uint64(BUCKETS)).astype(np.int64)]
    return Queries(ids, place(words), place(answers), np.array([len(w).bit_length() if len(w) >= MIN_WORDS else 0 for w in words], np.int64), vocabulary, weights)


def _passages(docs: DataFrame, text: str, queries) -> DataFrame:
    """doc_id, th (hash of the text), size class, words of the passage on the vocabulary and those of its surroundings, where these share enough words with an item of the class to
    be a leak of it; for class 0 the item that stands there word by word (short)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        known = np.zeros(BUCKETS, bool)
        known[(q.vocabulary % np.uint64(BUCKETS)).astype(np.int64)] = True
        for batch in slices(batches, text):
            data, offsets = utf8(batch.column(text))
            hashes, start, _ = word_hashes(data, offsets, lower=True)
            if not len(hashes):
                continue
            bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
            place = np.full(len(hashes), -1)
            maybe = np.flatnonzero(known[bucket])
            at = np.minimum(np.searchsorted(q.vocabulary, hashes[maybe]), len(q.vocabulary) - 1)
            hit = q.vocabulary[at] == hashes[maybe]
            place[maybe[hit]] = at[hit]
            hits = np.flatnonzero(place >= 0)
            edge = np.searchsorted(start, offsets)
            order_of = np.argsort(place[hits], kind="stable")
            by_word = place[hits][order_of]
            ids, kinds, inner, outer, shorts = [], [], [], [], []
            for k in np.flatnonzero(q.classes == 0):
                item = q.words[k]
                at = hits[order_of[np.searchsorted(by_word, item[0]) : np.searchsorted(by_word, item[0], side="right")]]
                for d, x in enumerate(item[1:].tolist(), 1):
                    at = at[at + d < len(place)]
                    at = at[place[at + d] == x]
                doc = np.searchsorted(edge, at, side="right") - 1
                for i in np.unique(doc[at + len(item) <= edge[doc + 1]]):
                    ids.append(i)
                    kinds.append(0)
                    inner.append(item)
                    outer.append(item)
                    shorts.append(np.array([k]))
            for kind in np.unique(q.classes[q.classes > 0]):
                size, step = 1 << int(kind), max(1, 1 << int(kind) - 2)
                n = np.maximum(1, -(-(np.diff(edge) - size) // step) + 1) * (np.diff(edge) > 0)
                own = np.repeat(np.arange(len(n)), n)
                first = edge[own] + (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)) * step
                last = np.minimum(first + size, edge[own + 1])
                left, right = np.maximum(edge[own], first - size), np.minimum(edge[own + 1], last + size)
                windows = q.sharing(place, hits, left, right, int(kind))
                for i in windows.tolist():
                    within, around = place[first[i] : last[i]], place[left[i] : right[i]]
                    ids.append(own[i])
                    kinds.append(int(kind))
                    inner.append(within[within >= 0])
                    outer.append(around[around >= 0])
                    shorts.append(np.zeros(0, np.int64))
            if ids:
                lists = lambda parts: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)), pa.array(np.concatenate(parts).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids)), batch.column("th").take(pa.array(ids)), pa.array(kinds, pa.int32()), lists(inner), lists(outer), lists(shorts)], names=["doc_id", "th", "kind", "words", "around", "short"])

    return docs.select("doc_id", text, F.xxhash64(text).alias("th")).mapInArrow(run, "doc_id bigint, th bigint, kind int, words array<int>, around array<int>, short array<int>")


class Vectors:
    """Sparse vectors, sqrt(tf) * idf over the vocabulary, of the lists of words values[offsets[i]:offsets[i + 1]]."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray, weights: np.ndarray):
        self.n = len(offsets) - 1
        row = np.repeat(np.arange(self.n), np.diff(offsets))
        key, tf = np.unique(row * len(weights) + values[offsets[0] : offsets[-1]], return_counts=True)
        self.row, self.word = np.divmod(key, max(1, len(weights)))
        self.value = np.sqrt(tf) * weights[self.word]

    @classmethod
    def of(cls, column: pa.ListArray, weights: np.ndarray) -> Vectors:
        return cls(column.values.to_numpy(zero_copy_only=False).astype(np.int64), column.offsets.to_numpy(), weights)

    def latent(self, basis: np.ndarray) -> np.ndarray:
        """Each vector in the basis."""
        out = np.zeros((self.n, basis.shape[1]), basis.dtype)
        if len(self.row):
            start = np.flatnonzero(np.append(True, self.row[1:] != self.row[:-1]))
            out[self.row[start]] = np.add.reduceat(self.value[:, None].astype(basis.dtype) * basis[self.word], start)
        return out

    def back(self, latent: np.ndarray, total: np.ndarray) -> None:
        """Adds each vector times its latent vector to total."""
        order = np.argsort(self.word, kind="stable")
        word = self.word[order]
        if len(word):
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            total[word[start]] += np.add.reduceat(self.value[order, None] * latent[self.row[order]], start)


def _item_vectors(q: Queries) -> Vectors:
    return Vectors(np.concatenate([np.zeros(0, np.int64), *q.words]), np.concatenate([[0], np.cumsum([len(w) for w in q.words])]).astype(np.int64), q.weights)


def latent_basis(passages: DataFrame, q: Queries, shared) -> np.ndarray:
    """Right singular vectors of passages and items together: V <- orth(A'A V), with A'A V summed over tasks block by block."""
    spark = passages.sparkSession
    rank = min(RANK, len(q.vocabulary))
    basis = np.linalg.qr(np.random.default_rng(42).standard_normal((len(q.vocabulary), rank)))[0]
    for _ in range(ROUNDS):
        now = spark.sparkContext.broadcast(basis)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, v = shared.value, now.value
            total, some = np.zeros_like(v), False
            for batch in batches:
                for lo in range(0, batch.num_rows, 2048):
                    vectors = Vectors.of(batch.slice(lo, 2048).column("words"), own.weights)
                    vectors.back(vectors.latent(v), total)
                    some = True
            if some:
                blocks = [total[i : i + _BLOCK].tobytes() for i in range(0, len(total), _BLOCK)]
                salt = pa.array(np.full(len(blocks), TaskContext.get().partitionId() % _SALTS), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), salt, pa.array(blocks, pa.binary())], names=["block", "salt", "part"])

        def add(of: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_py(), np.float64) for x in of.column("part"))
            return of.slice(0, 1).set_column(2, "part", pa.array([total.tobytes()], pa.binary()))

        # In two steps, so that no group holds a part of every task.
        form = "block int, salt int, part binary"
        summed = passages.select("words").mapInArrow(run, form).groupBy("block", "salt").applyInArrow(add, form).groupBy("block").applyInArrow(add, form)
        total = np.zeros_like(basis)
        for row in summed.collect():  # vocabulary x rank numbers, a bounded size
            part = np.frombuffer(row.part, np.float64).reshape(-1, rank)
            total[row.block * _BLOCK : row.block * _BLOCK + len(part)] = part
        items = _item_vectors(q)
        items.back(items.latent(basis), total)
        basis = np.linalg.qr(total)[0]
        now.unpersist()
    return basis


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        if m := masks.get(y):
            both = row & m
            row = (row + both | row - both) & full
    return len(a) - row.bit_count()


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, item_id, cosine (latent), covered (share of the item's words) and answer (share of the answer's) of each leak."""
    return _best(_leaks(docs, items, text), "doc_id", "item_id")


def _best(leaks: DataFrame, *keys: str) -> DataFrame:
    return leaks.groupBy(*keys).agg(F.max("cosine").alias("cosine"), F.max("covered").alias("covered"), F.max("answer").alias("answer"))


def _leaks(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The same with th, the hash of the document's text, for each passage."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    total = counts(docs, text)
    idf_table = np.log((total.sum() + 1) / (total + 1)).astype(np.float64) + 1e-6
    schema = "doc_id bigint, th bigint, item_id bigint, cosine double, covered double, answer double"
    n_blocks = -(-items.count() // ITEMS)
    block_of = F.pmod(F.xxhash64("item_id"), F.lit(max(1, n_blocks)))
    out = spark.createDataFrame([], schema)
    for block in range(n_blocks):  # of the stated query set
        q = _queries(items.select("item_id", "text").where(block_of == block).orderBy("item_id").collect(), idf_table)
        if not q.ids:
            continue
        shared = spark.sparkContext.broadcast(q)
        passages = scratch.write(_passages(docs, text, shared))
        basis = spark.sparkContext.broadcast(latent_basis(passages, q, shared).astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            targets = unit(_item_vectors(own).latent(basis.value))
            for batch in batches:
                for lo in range(0, batch.num_rows, 2048):
                    part = batch.slice(lo, 2048)
                    kinds, ids, hashes = part.column("kind").to_numpy(), part.column("doc_id").to_pylist(), part.column("th").to_pylist()
                    cosine = unit(Vectors.of(part.column("words"), own.weights).latent(basis.value)) @ targets.T
                    around = part.column("around")
                    found = []
                    near = (cosine >= LATENT_COSINE) & (kinds[:, None] == own.classes[None, :]) & (kinds[:, None] > 0)
                    short = part.column("short").to_pylist()
                    for i in np.flatnonzero(kinds == 0):  # items of a few words, which stand there word by word
                        near[i, short[i]] = True
                    last, words = -1, None
                    for i, k in np.argwhere(near).tolist():
                        if i != last:
                            last, words = i, around[i].values.to_numpy(zero_copy_only=False)
                        covered = common(own.words[k], words) / len(own.words[k])
                        if covered < COVERED_WITH_ANSWER:
                            continue
                        answer = common(own.answers[k], words) / len(own.answers[k])
                        if covered >= COVERED or answer >= ANSWER_COVERED:
                            found.append((ids[i], hashes[i], own.ids[k], float(cosine[i, k]), covered, answer))
                    if found:
                        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=["doc_id", "th", "item_id", "cosine", "covered", "answer"])

        out = out.unionByName(passages.mapInArrow(run, schema))
    return out


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leak."""
    leaks = _leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leak"), F.col("th").alias("of")).distinct()
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("th"))
    return whole.join(leaks, F.col("doc_id").eqNullSafe(F.col("leak")) & (F.col("th") == F.col("of")), "left_anti").select("row.*")
