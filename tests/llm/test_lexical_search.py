"""Ranked lexical search against a plain ranking of all documents."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest

from intervalia.llm import lexical_search
from intervalia.llm.lexical_search import search

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
ITEM, DOC = "item_id bigint, text string", "text string, item_id string, doc_id bigint, N int, score int"


def brute(docs, items, k=10):
    own = [(i, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n_docs, total = len(own), sum(sum(c.values()) for _, c in own)
    df = collections.Counter(t for _, c in own for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for doc, c in own:
            m = 25 + (75 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in TERM.findall((text or "").translate(LOWER)) if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("portion, first", [(1 << 20, 64), (40, 1), (500, 3)])
def test_equals_a_plain_ranking(spark, monkeypatch, portion, first):
    monkeypatch.setattr(lexical_search, "PORTION", portion)
    monkeypatch.setattr(lexical_search, "FIRST_READ", first)
    rng = random.Random(portion)
    vocabulary = [f"w{k}" for k in range(60)] + ["Été", "ÉTÉ", "a_b", "x-y", "日本", "A", "a"]
    text = lambda n: " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=n))
    docs = [(k, text(rng.randint(0, 40))) for k in range(150)] + [(1000 + k, "w3 w3 w9, w9 A") for k in range(30)] + [(None, "w3 w3 w9 w9 a"), (None, None), (7, None), (8, ""), (9, " ,.-_"), (5, "w50 " * 5000)]
    docs += docs[:3]  # repeated rows
    items = [(k, text(rng.randint(1, 30))) for k in range(25)] + [(90, "w3 w9"), (90, "w3 w9"), (90, "w50"), (91, None), (92, ""), (93, "nowhere"), (None, "w1 w1 w1"), (94, "w0")]
    given = spark.createDataFrame([(t, "x", i, 1, 2) for i, t in docs], DOC).repartition(3)
    assert found(search(given, spark.createDataFrame(items, ITEM))) == brute(docs, items)


def test_in_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 40)
    docs = [(k, f"alpha beta{k % 7} gamma{k % 3}") for k in range(50)]
    items = [(k, f"beta{k} gamma1 alpha") for k in range(8)]
    d, i = spark.createDataFrame([(t, "x", k, 1, 2) for k, t in docs], DOC), spark.createDataFrame(items, ITEM)
    assert found(search(d, i)) == brute(docs, items)
    assert search(d.limit(0), i).count() == 0 and search(d, i.limit(0)).count() == 0


def test_reading_stops_early():
    """Lists of a long tail aren't read to their ends."""
    n = 100_000
    term, doc = np.repeat([0, 1], n), np.tile(np.arange(n), 2)
    tf = np.ones(2 * n, np.int64)
    tf[[3, n + 3, 8, n + 8]] = 50
    portion = lexical_search.Portion(term, doc, tf, np.full(n, 100), 2)
    reads, own = [], portion.doc
    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                reads.append(key.stop - key.start)
            return np.asarray(self)[key]
    portion.doc = own.view(Counted)
    docs, score = portion.best(np.array([0, 1]), np.array([5, 7]), 2, np.zeros(0, np.int64))
    assert sorted(docs.tolist()) == [3, 8] and len(set(score.tolist())) == 1
    assert sum(reads) < 1000


def test_registered_query_against_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    got = found(lexical_search.op13_ranked_search(spark, SF))
    assert got == sorted(con.sql(lexical_search.ORACLE).fetchall(), key=str) and got
