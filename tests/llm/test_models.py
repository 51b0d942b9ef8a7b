"""Language id and the compression classifier against plain loops; columns that clash in another case."""

import collections
import math
import random
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from intervalia.llm import language_id, quality_classifier, quality_rules

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def features(text):
    """Hashed 1- to 3-grams of the letters of a text, words apart by one blank."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    points = [ord(c) for c in " " + " ".join(words) + " "] if words else []
    for order in (1, 2, 3):
        for i in range(len(points) - order + 1):
            v = 0
            for n in range(1, order + 1):
                v = (v * 0x9E3779B97F4A7C15 + points[i + n - 1] + n) & MASK
            yield (((v ^ (v >> 29)) * 0xBF58476D1CE4E5B9) & MASK) >> (64 - 15)


def plain_bayes(learnt, asked):
    counts, texts = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in learnt:
        if text is not None and lang is not None:
            texts[lang] += 1
            counts[lang].update(features(text))
    total = {k: sum(c.values()) + 0.5 * (1 << 15) for k, c in counts.items()}
    for text in asked:
        if not any(map(str.isalpha, text or "")) or not texts:
            yield "und", 0.0
            continue
        seen = collections.Counter(features(text))
        logs = {k: math.log(texts[k] / sum(texts.values())) + sum(n * math.log((counts[k][f] + 0.5) / total[k]) for f, n in seen.items()) for k in texts}
        best = max(logs, key=lambda k: logs[k])
        yield best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())


ODD = [None, "", "  \n", "123 !?", "é", "ẞtraße 12 naïve", "İi ıI", "日本語 テスト", "a" * 4000, "the the the\x00und", "l'été à la plage", "𝒳 math"]


def test_language_id_is_naive_bayes(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = [(r.doc_id, r.text, r.lang) for r in rows] + [(100_000 + i, t, random.Random(i).choice([None, "en"])) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    langs, model = language_id.train(docs.where(language_id.fold(4) != 2))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs.select("doc_id", "text"), langs, model).collect()}
    want = plain_bayes([(t, x) for d, t, x in rows if not out(d)], [t for _, t, _ in rows])
    for (d, _, _), (lang, score) in zip(rows, want):
        assert got[d][1] == pytest.approx(score, abs=1e-3)
        assert got[d][0] == lang or abs(score - 0.5) < 1e-2


def test_classifier_is_the_difference_of_compressed_sizes(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    fold = language_id.fold(3)
    model = quality_classifier.train(docs.where(fold != 1).select("doc_id", "text"), labels.where(fold != 1).select("doc_id", "quality"))
    assert model.good and model.bad and model.slope > 0
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    found = {r.doc_id: r for r in quality_classifier.op8_quality_classifier(spark, SF).collect()}
    assert set(found) == set(text)

    def size(block, dictionary):
        own = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False)
        return len(own.compress(block))

    for d in sorted(text)[::3]:
        raw = (text[d] or "").encode()
        saved = sum(size(raw[i : i + 1024], model.bad) - size(raw[i : i + 1024], model.good) for i in range(0, len(raw), 1024))
        x = saved / len(raw) if raw else 0.0
        assert found[d].score == pytest.approx(1 / (1 + math.exp(-(model.slope * x + model.intercept))), abs=1e-9)
        assert found[d].predicted == int(found[d].score >= 0.5) and found[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1)


def test_quality_rules_replace_columns_in_any_case(spark):
    rows = spark.createDataFrame([(1, "one two", "clash", 7)], "doc_id bigint, text string, KEPT string, N_Words int")
    got = quality_rules.quality_rules(rows)
    assert got.columns == ["doc_id", "text", *quality_rules.ADDED]
    row = got.select("kept", "n_words").first()
    assert (row.kept, row.n_words) == (False, 2)
    kept = quality_rules.stage(spark, rows.withColumn("text", F.expr("repeat('A fair sentence of words, number ' || doc_id || '. ', 1)")), SF)
    assert kept.columns == rows.columns and kept.count() == 0
