"""Operator 13, ranked lexical search by NRA (no random access).

The items are the stated query set. One pass over the documents keeps of each its number of terms and, for the items' terms, how often it has them;
counts over all documents give each term's weight. A task then takes its documents in portions of PORTION postings. Of each portion it makes a list
for each term, sorted by falling impact, and reads an item's lists from the top, all in step, block after block. Each document met has a lower bound
(the impacts read) and an upper one (for each list that it hasn't been met in, the impact that this list has reached). Reading stops when the k-th best lower
bound is above what an unmet document can have, and when all documents whose upper bound reaches it have equal bounds: then members, ties and scores are final.
A task carries its best k of each item from portion to portion as the bound to beat, so it sends k rows an item at most, and Spark keeps the best k
of these. Documents aren't shuffled.

Items are taken in blocks of BLOCK_BYTES of text, which bounds what is broadcast. Terms are told apart by 64-bit hashes.

Edge cases: null and empty texts have no terms, are in no count and are never found. An item without terms, or whose terms no document has, gives no rows.
Repeated rows of documents are documents of their own; of items equal in id and text one is taken, and items without an id are found as null. Among equal scores
a document without an id comes last. Empty tables give no rows. Extra columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, slices, table, utf8
from .words import word_hashes

TOP = 10
BLOCK_BYTES, PORTION = 4 << 20, 1 << 20
#: Postings that are read from each list at first; each further read takes twice as many.
FIRST_READ = 64
#: A-Z lower-cased, other ASCII that isn't a letter or digit made a blank.
_TERM = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each term."""
    hashes, start, _ = word_hashes(_TERM[data], offsets)
    return hashes, start


@dataclass
class Items:
    """A block of items: ids, for each its terms as places in the sorted vocabulary and how often it has them."""

    ids: list[int | None]
    terms: list[np.ndarray]
    times: list[np.ndarray]
    vocabulary: np.ndarray


def _items(rows: list) -> Items:
    found = []
    for row in rows:
        raw = np.frombuffer((row.text or "").encode(), np.uint8)
        hashes, _ = term_hashes(raw, np.array([0, len(raw)]))
        if len(hashes):
            found.append((row.item_id, *np.unique(hashes, return_counts=True)))
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for _, h, _ in found)]))
    return Items([i for i, _, _ in found], [np.searchsorted(vocabulary, h) for _, h, _ in found], [n for _, _, n in found], vocabulary)


def postings(docs: DataFrame, text: str, items) -> DataFrame:
    """doc_id, n (terms with repeats), and of the items' terms those that the document has, with tf, for each document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = items.value.vocabulary
        for batch in slices(batches, text):
            data, offsets = utf8(batch.column(text))
            hashes, start = term_hashes(data, offsets)
            edge = np.searchsorted(start, offsets)
            n = np.diff(edge)
            own = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            hit = vocabulary[at] == hashes
            key, tf = np.unique(own[hit] * len(vocabulary) + at[hit], return_counts=True)
            row, term = np.divmod(key, len(vocabulary))
            some = np.flatnonzero(n)
            begin = pa.array(np.searchsorted(row, np.append(some, len(n))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(begin, pa.array(c.astype(np.int32))) for c in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(some)), pa.array(n[some].astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Portion:
    """Some documents' postings as lists by term, each sorted by falling impact."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, m: np.ndarray, n_terms: int):
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        order = np.lexsort((-impact, term))
        self.doc, self.impact, self.n_docs = doc[order], impact[order], len(m)
        self.begin = np.searchsorted(term[order], np.arange(n_terms + 1))

    def best(self, terms: np.ndarray, factors: np.ndarray, k: int, beat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of all with a score above 0 that may be among the best k beside the scores to beat; those that tie with the last one are all there."""
        keep = (factors > 0) & (self.begin[terms + 1] > self.begin[terms])
        terms, factors = terms[keep], factors[keep]
        at, end = self.begin[terms].copy(), self.begin[terms + 1]
        lower = np.zeros(self.n_docs, np.int64)
        unmet = np.ones((len(terms), self.n_docs), bool)
        alive: np.ndarray | None = None  # from when on no unmet document can come in
        read = FIRST_READ
        while True:
            for i, factor in enumerate(factors):
                hi = min(at[i] + read, end[i])
                doc = self.doc[at[i] : hi]
                lower[doc] += factor * self.impact[at[i] : hi]
                unmet[i, doc] = False
                at[i] = hi
            read *= 2
            reached = np.where(at < end, factors * self.impact[np.minimum(at, len(self.impact) - 1)], 0) if len(at) else np.zeros(0, np.int64)
            held = np.concatenate([beat, lower])
            bar = max(1, int(np.partition(held, len(held) - k)[len(held) - k])) if len(held) >= k else 1
            if alive is None and reached.sum() < bar:
                alive = np.flatnonzero(lower)
            if alive is None:
                continue
            upper = lower[alive] + sum((unmet[i, alive] * r for i, r in enumerate(reached) if r), np.zeros(len(alive), np.int64))
            near = upper >= bar
            alive, upper = alive[near], upper[near]
            if (upper == lower[alive]).all():
                return alive, lower[alive]


def _leading(score: np.ndarray, none: np.ndarray, doc_id: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((doc_id, none, -score))[:k]


def _ranked(rows: DataFrame, items, weight, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item (place in the block), doc_id, score: each task's best k of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, w = items.value, weight.value
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(q.ids)

        def add(parts: list[pa.RecordBatch]) -> None:
            whole = pa.Table.from_batches(parts).combine_chunks()
            terms, tfs = (whole[c].combine_chunks() for c in ("terms", "tfs"))
            n = whole["n"].to_numpy()
            doc = np.repeat(np.arange(len(n)), np.diff(terms.offsets.to_numpy()))
            m = 25 + (75 * n * n_docs) // n_terms
            portion = Portion(terms.flatten().to_numpy().astype(np.int64), doc, tfs.flatten().to_numpy().astype(np.int64), m, len(q.vocabulary))
            none = whole["doc_id"].is_null().to_numpy()
            ids = whole["doc_id"].fill_null(0).to_numpy()
            for i, (own, times) in enumerate(zip(q.terms, q.times)):
                found, score = portion.best(own, w[own] * times, k, best[i][0])
                joined = [np.concatenate(p) for p in zip(best[i], (score, none[found], ids[found]))]
                lead = _leading(*joined, k)
                best[i] = tuple(c[lead] for c in joined)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten()) + batch.num_rows
            if size >= PORTION:
                add(held)
                held, size = [], 0
        if held:
            add(held)
        item = np.repeat(np.arange(len(q.ids)), [len(b[0]) for b in best])
        if len(item):
            score, none, ids = (np.concatenate(p) for p in zip(*best))
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array([q.ids[i] for i in item], pa.int64()), pa.array(ids, mask=none), pa.array(score)], names=["item", "item_id", "doc_id", "score"])

    return rows.mapInArrow(run, "item int, item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of each item's k highest-scoring documents with a score above 0; equal scores by doc_id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    stated = items.select("item_id", "text").distinct()
    size = stated.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-size // BLOCK_BYTES)
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in range(n_blocks):
        q = _items(stated.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).orderBy("item_id", "text").collect())
        if not q.ids:
            continue
        shared = spark.sparkContext.broadcast(q)
        rows = scratch.write(postings(docs, text, shared))
        n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        found = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()  # a row for each term of the block
        df = np.zeros(len(q.vocabulary), np.int64)
        df[found["term"].to_numpy()] = found["df"].to_numpy()
        ranked = _ranked(rows, shared, spark.sparkContext.broadcast(weights(df, n_docs)), n_docs, n_terms, k)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        out = out.unionByName(ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("item"))
    return out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
with d as (select doc_id, row_number() over () as r, {_TERMS} as ts from documents),
tot as (select count(*) as nd, cast(sum(len(ts)) as bigint) as nt from d where len(ts) > 0),
q as (select i, item_id, term, count(*) as k from (select i, item_id, unnest(ts) as term from (select row_number() over () as i, item_id, {_TERMS} as ts from (select distinct item_id, text from benchmark))) group by all),
tf as (select r, term, count(*) as tf from (select r, unnest(ts) as term from d) where term in (select term from q) group by all),
w as (select term, cast(floor(1000 * ln((2 * nd + 2)::double / (2 * df + 1)::double)) as bigint) as w from (select term, count(*) as df from tf group by term), tot),
s as (select i, item_id, doc_id, cast(sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(ts) * nd) // nt)))) as bigint) as score
      from q join w using (term) join tf using (term) join d using (r), tot group by i, item_id, doc_id, r having score > 0),
k as (select *, row_number() over (partition by i order by score desc, doc_id) as rank from s)
select item_id, cast(rank as int) as rank, doc_id, score from k where rank <= {TOP}
"""
