"""Licence scans against a search of all spans of words by edit distance."""

import random
import re

import pytest

from intervalia.llm import license_scan
from intervalia.llm.license_scan import NOTICES, PHRASES, Scanner, find_notices, normal, notice

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def fewest(ws, n):
    """Edits of the best span of whole words, or None."""
    best = None
    for i in range(len(ws)):
        for j in range(i + 1, len(ws) + 1):
            span = " ".join(ws[i:j])
            if len(span) > len(n.words) + n.edits:
                break
            if len(span) >= len(n.words) - n.edits and (d := distance(span, n.words)) <= n.edits and (best is None or d < best):
                best = d
    return best


def base(text):
    ws = words(text)
    return [(n.label, i) for n in PHRASES for i in range(len(ws)) if ws[i : i + len(n.words.split())] == n.words.split()]


def changed(rng, text, k):
    for _ in range(k):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice("abcxyz é-") + text[i:], text[:i] + rng.choice("abcxyz é") + text[i + 1 :]])
    return text


def test_against_all_spans():
    rng, scanner = random.Random(3), Scanner(NOTICES)
    prose = "the use of this work is free and released to any copy of the public with rights".split()
    for _ in range(250):
        parts = []
        for _ in range(rng.randint(1, 3)):
            n = rng.choice(NOTICES)
            parts += [*rng.choices(prose, k=rng.randint(0, 5)), changed(rng, n.words, rng.choice([0, 1, n.edits, n.edits + 1, n.edits + 2]))]
        text = rng.choice([" ", ", ", "\n"]).join(parts)
        found = scanner.spans(normal(text))
        for k, n in enumerate(NOTICES):
            own = [e for i, _, _, e in found if i == k]
            assert (min(own) if own else None) == fewest(words(text), n), (text, n)


def test_spans_are_what_they_say():
    scanner = Scanner((notice("mit", "released under the mit license"),))
    text = normal("x Released UNDER teh mit license, y. released under the mit licence z")
    assert [(text[a:b], e) for _, a, b, e in scanner.spans(text)] == [("released under teh mit license", 2), ("released under the mit licence", 1)]


@pytest.mark.parametrize("text", [None, "", " \n", "MIT License", "mit-license mit license MIT\tLICENSE", "mit licenseé", "general public license general public license", "émit license", "mit  license apache_license", "x" * 200_000, "mit license " * 20_000])
def test_phrases(spark, text):
    row = find_notices(spark.createDataFrame([("clash", text, 1, "c"), ("clash", text, 1, "c"), ("clash", text, None, "c")], "spans string, text string, doc_id int, label string").selectExpr("spans", "text", "cast(doc_id as bigint) as doc_id", "label")).collect()
    assert len(row) == 3 and row[0] == row[1]
    assert row[0].n_words == len(words(text))
    assert sorted((s.label, s.first) for s in row[0].spans if s.phrase) == (sorted(base(text)) if len(text or "") < 1000 else [("mit", 2 * k) for k in range(20_000)] if text[0] == "m" else [])


def test_registered_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = license_scan.op11_license_scan(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        own = base(docs[r.doc_id])
        at = [i for _, i in own]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words(docs[r.doc_id])), len(own), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for x, _ in own})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and bool(r.labels) == (r.score > 0)
    text = {r.doc_id: r.labels for r in got}
    assert all(("cc-by-nc" in text[i]) == ("CC BY-NC" in (t or "")) and ("reserved" in text[i]) == ("All rights reserved" in (t or "")) for i, t in docs.items())


def test_empty(spark):
    assert find_notices(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
