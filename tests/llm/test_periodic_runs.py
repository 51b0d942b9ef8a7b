"""Periodic runs against a scan of every period of every text."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from intervalia.llm import periodic_runs
from intervalia.llm.periodic_runs import find_runs, op12_periodic_runs

SF = "/root/testdata/sf0.001"


def plain(words):
    """All runs: for each period the maximal stretches of equal words so far apart; of equal stretches the smallest period."""
    ids = np.unique(np.array(words, object), return_inverse=True)[1] if len(words) else np.zeros(0, np.int64)
    found = {}
    for q in range(1, len(ids) // 3 + 1):
        same = np.concatenate([[0], (ids[q:] == ids[:-q]).astype(np.int8), [0]])
        for s, e in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)):
            if e - s + q >= max(24, 3 * q):
                found.setdefault((int(s), int(e + q)), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def rewritten(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = rewritten(doc_id, (text or "").encode().split())
    runs = plain(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    return (
        doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def texts(rng):
    few = lambda n, k: [rng.choice("abcdefgh"[:k]) for _ in range(n)]
    out = [[], ["a"] * 23, ["a"] * 24, ["a"] * 1000, ["a", "b"] * 500, few(2000, 2), few(3000, 3)]
    for _ in range(60):
        text = few(rng.randint(0, 40), 8)
        for _ in range(rng.randint(1, 4)):
            block = few(rng.randint(1, 60), rng.choice([1, 2, 5, 8]))
            n = rng.randint(len(block), 8 * len(block) + 20)
            text += (block * (n // len(block) + 1))[:n] + few(rng.randint(0, 10), 8)
        out.append(text)
    fib = ["a", "ab"]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    inner = (["a"] * 30 + ["b"]) * 6
    thue = ["ab"[bin(i).count("1") % 2] for i in range(4096)]
    return [*out, list(fib[-1]), (inner + ["c"]) * 5, thue, thue[:1024] * 4, *([out[20]] * 3)]


def test_against_every_period():
    many = texts(random.Random(1))
    ids = np.unique(np.array([w for t in many for w in t], object), return_inverse=True)[1]
    own = np.repeat(np.arange(len(many)), [len(t) for t in many])
    begin = np.concatenate([[0], np.cumsum([len(t) for t in many])])
    of, start, end, q = find_runs(ids, own)
    for k, t in enumerate(many):
        got = [(int(s - begin[k]), int(e - s), int(p)) for s, e, p in zip(start[of == k], end[of == k], q[of == k])]
        assert got == plain(t), k
    alone = [find_runs(np.unique(np.array(t, object), return_inverse=True)[1], np.zeros(len(t), np.int64)) if t else None for t in many]
    for t, a in zip(many, alone):
        assert a is None or sorted(zip(a[1].tolist(), (a[2] - a[1]).tolist(), a[3].tolist())) == plain(t)


def test_long_texts_take_time_in_proportion():
    took = []
    for n in (20_000, 80_000):
        for ids in (np.zeros(n, np.int64), np.arange(n) % 7, np.arange(n) % (n // 4), np.random.default_rng(1).integers(0, 50, n)):
            began = time.time()
            find_runs(ids, np.zeros(n, np.int64))
            took.append(time.time() - began)
    assert sum(took[4:]) < 12 * max(0.5, sum(took[:4]))


def test_query(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, rng.choice([" ", "\n", "\t "]).join(t), "x", 1) for k, t in enumerate(texts(rng))]
    rows += [(1000, None, "x", 1), (1001, "", "x", 1), (1002, " \n ", "x", 1), (None, "é é " * 30, "x", 1), (None, None, "x", 1), (5, rows[5][1], "x", 1), *((2000 + k, "one two three four five six seven eight " * 4, "x", 1) for k in range(40))]
    spark.createDataFrame(rows, "doc_id bigint, text string, runs string, n_words int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, op12_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=str)
    assert got == sorted((expected(i, t) for i, t, *_ in rows), key=str)
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_registered_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = sorted(map(tuple, op12_periodic_runs(spark, SF).collect()), key=str)
    assert got == sorted((expected(r.doc_id, r.text) for r in docs), key=str)
    assert any(r[1] for r in got)
