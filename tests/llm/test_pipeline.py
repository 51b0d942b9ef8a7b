"""The pipeline's stages one by one: each keeps what it should, and all but the last return the columns of documents."""

import collections
import random
import re

import pytest

from intervalia.llm import bpe, quality_rules, simhash
from tests.llm.test_operators import covering, removed_lines

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now and now <= ids
        assert set(columns) <= set(docs.columns) if k == 4 else docs.columns == columns
        ids = now


def test_rows_without_an_id_of_their_own(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    texts = [f"{w} one two three {w} four five six {w} seven" for w in ("north", "south", "east")]
    docs = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[0] + " and more of it " + texts[2]), (None, item), (5, item)], "doc_id bigint, text string")
    stages = dict(corpus_pipeline.STAGES)
    key = lambda df: sorted((str(r.doc_id), r.text) for r in df.collect())
    assert key(stages["decontamination"](spark, docs, SF)) == key(docs.where(docs.text != item))
    assert key(stages["simhash"](spark, docs, SF)) == key(docs.where("text != '%s' or doc_id = 5" % item).distinct())


def test_stages_keep_columns_of_any_name(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["_words", "_lines", "_text", "_row", "row", "n", "kept", "_kept", "_of", "of", "_th", "th", "leak", "_leak", "removed", "n_words", "clean_text", "root", "fp"]
    docs = base.selectExpr("*", *(f"'{c}' as {c}" for c in names))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.select(*names).distinct().collect()
        assert [r.asDict() for r in rows] == [{c: c for c in names}], name
        plain = stage(spark, base, SF)
        assert out.count() == plain.count(), name
        assert stage(spark, docs.limit(0), SF).count() == 0


def _cleaned(text):
    """What the quality rules keep of a text, or None."""
    words = [w for w in re.split("[ \\t-\\r]+", text or "") if w]
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    repeated = {k + d for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for d in range(3)}
    if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
        return None
    kept, lost, total = [], 0, 0
    for line in text.split("\n"):
        if not re.search("[^ \\t-\\r]", line):
            kept.append(line)
            continue
        n = line.count(" ") + 1
        fails = 100 * sum(map(line.count, "#*$%&|<>")) > 10 * len(line) or sum(line.count(f" {c} ") for c in "|>»•") >= max(3, 20 * n / 100)
        fails = fails or 100 * line.count("!!") > 50 * n or (n >= 4 and not re.search("[.!?;:…。]", line)) or any(b in line.lower() for b in quality_rules.LineRules.boilerplate)
        total, lost = total + len(line), lost + len(line) * fails
        kept += [] if fails else [line]
    return None if 100 * lost > 30 * total else "\n".join(kept)


def test_run_against_brute_force(spark, tmp_path):
    """Planted cases through all stages: boilerplate, short texts, repeated and similar lines, near copies, benchmark items, rows without an id."""
    import public_tokenizers
    import tiktoken

    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(900)]
    sentence = lambda n: " ".join(rng.choices(vocabulary, k=n)) + "."
    item = sentence(24) + " " + sentence(6)
    menu, lines = "home | about | terms of use | contact", [sentence(18) for _ in range(6)]
    texts = ["\n".join(sentence(20) for _ in range(6)) for _ in range(12)]
    similar = lines[0].split()
    similar[4] = "changed"
    near = texts[0].replace(texts[0].split()[3], "other", 1)
    texts += [sentence(10), None, "", "word " * 80, f"{menu}\n" + texts[1], *("\n".join([lines[0], sentence(30), lines[k % 6], sentence(30)]) for k in range(5)), "\n".join([" ".join(similar), sentence(40), sentence(30)]), texts[2], near, sentence(60) + " " + item + " " + sentence(40), "\n".join(["###### $$$$ ||||", *(sentence(20) for _ in range(4))])]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)] + [(None, "\n".join(sentence(25) for _ in range(3)), None, None, 1) for _ in range(2)] + [(5, "\n".join(sentence(25) for _ in range(3)), None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    now = [(d, c) for d, t, *_ in rows if (c := _cleaned(t)) is not None]
    hashes = {r.text: r.h for r in spark.createDataFrame([(t,) for _, t in now], "text string").selectExpr("text", "xxhash64(text) as h").collect()}
    now = list(removed_lines(now, hashes).elements())
    hashes = {r.text: r.h for r in spark.createDataFrame([(t,) for _, t in now], "text string").selectExpr("text", "xxhash64(text) as h").collect()}
    order, kept = sorted(now, key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1]])), []
    prints = [simhash.fingerprint(t) & (2**64 - 1) for _, t in order]
    root = list(range(len(order)))
    while (new := [min(root[j] for j in range(len(order)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(order))]) != root:
        root = new
    now = [r for i, r in enumerate(order) if root[i] == i]
    now = [r for r in now if not covering(item, r[1])]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.tiktoken_ranks(f.read()), special_tokens={})
    want = sorted((str(d), t, ",".join(map(str, library.encode_ordinary(t)))) for d, t in now)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((str(r.doc_id), r.text, r.ids) for r in got.collect()) == want
    assert 15 <= len(want) < len(rows) - 6 and set(docs.columns) <= set(got.columns)
