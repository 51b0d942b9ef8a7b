"""The corpus operators against brute force, libraries and round trips, on small tables with the awkward cases."""

import base64
import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from intervalia.llm import bpe, bpe_codec, decontamination, language_id, line_dedup, quality_classifier, quality_rules, simhash, suffix_dedup, token_counts, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, ids string, removed int"
LONG = "lorem don't 12 été 日本 " * 4000


def extra(doc_id, text):
    return (doc_id, text, None, "s", 1, "clash", "clash", 7)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [extra(1, None), extra(2, ""), extra(3, "one"), extra(4, LONG), extra(5, LONG), extra(6, "same line of five words here.\nsame line of five words here.\n"), extra(6, "same line of five words here.\nsame line of five words here.\n"), extra(None, "an id is missing here but text is not"), extra(8, "  \n\t\n"), extra(9, "x" * 3000), extra(10, "<|endoftext|> a  b <|endoftext|>")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(t):
    return (t or "").encode().split()


def test_quality_rules(odd, docs):
    for frame in (odd, docs):
        for r in quality_rules.quality_rules(frame).collect():
            w = [x for x in (r.text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
            grams = collections.Counter(zip(w, w[1:], w[2:]))
            inside = {k + d for k in range(len(w) - 2) if grams[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)}
            lines = [x for x in (r.text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
            assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(inside))
            assert r.n_symbols == sum((r.text or "").count(c) for c in "#*$%&|<>")
            assert r.n_dup_lines == len(lines) - len(set(lines))
            assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
            assert not (r.base_failed and r.kept)


def test_token_counts(odd, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for frame in (odd, docs):
        for r in token_counts.token_counts(frame).collect():
            n = len(library.encode(r.text or "", add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 512)


def test_token_counts_of_long_pieces(monkeypatch):
    import time

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    with open(path, "rb") as f:
        transducer, added = token_counts.compiled(f.read())
    rng = random.Random(6)
    pieces = ["a" * 30_000, "".join(rng.choices("abcdefghij", k=20_000)), "".join(rng.choices("thequickandslow", k=50_001)), "é日" * 9_000, "=" * 12_345, "ab" * 7_000]
    for chunk, warm, most in ((1024, 256, 200_000), (1024, 0, 200_000), (64, 3, 3_000)):  # bad guesses and few states give the same
        monkeypatch.setattr(token_counts, "PIECE_CHUNK", chunk)
        monkeypatch.setattr(token_counts, "WARM", warm)
        monkeypatch.setattr(token_counts, "MOST_STATES", most)
        for text in pieces:
            raw = np.frombuffer(text.encode(), np.uint8)
            assert token_counts.counts(transducer, added, raw, np.array([0, len(raw)])).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]
            assert len(transducer.keys) <= most + 2_000
    monkeypatch.undo()
    raw = np.frombuffer("".join(rng.choices("abcdefghij", k=1_000_000)).encode(), np.uint8)
    began = time.time()
    token_counts.counts(transducer, added, raw, np.array([0, len(raw)]))
    assert time.time() - began < 60


def test_bpe_codec(odd, docs):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.tiktoken_ranks(f.read()), special_tokens={})
    for frame in (odd, docs):
        for r in bpe_codec.decode(bpe_codec.encode(frame)).collect():
            assert r.ids == library.encode_ordinary(r.text or "")
            assert bytes(r.decoded) == (r.text or "").encode()


def test_prefixes_append_and_edit():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        b = bpe.Bpe(bpe.tiktoken_ranks(f.read()))
    rng = random.Random(5)
    for _ in range(60):
        own = bpe.Prefixes(b, bytes(rng.choices(b"abcdestringho", k=30)))
        own.append(bytes(rng.choices(b"theringsa", k=9)))
        own.edit(rng.randrange(10), rng.randrange(10, 20), bytes(rng.choices(b"anthe", k=rng.randrange(5))))
        assert own.tokens() == b.merged(own.piece)


def test_language_id(spark, docs, odd):
    langs, model = language_id.train(docs.where(language_id.fold(4) != 2))
    found = language_id.identify(docs, langs, model).where(language_id.fold(4) == 2).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95
    for r in language_id.identify(odd, langs, model).collect():
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
    none, empty = language_id.train(docs.limit(0))
    assert none == [] and {r.lang_pred for r in language_id.identify(odd, none, empty).collect()} == {"und"}


def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.01"
    found = quality_classifier.op8_quality_classifier(spark, sf)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    assert np.mean([(r.score - r.quality) ** 2 for r in rows]) < 0.06  # Brier score; always saying the share of label 1 gives over 0.1
    assert abs(np.mean([r.score for r in rows]) - np.mean([r.quality for r in rows])) < 0.08


def test_classifier_edges(spark, odd):
    none = odd.select("doc_id", F.lit(1).alias("quality")).limit(0)
    model = quality_classifier.train(odd, none)
    assert {round(r.score, 6) for r in quality_classifier.score(odd, model).collect()} == {0.5}
    assert quality_classifier.score(odd.limit(0), model).count() == 0
    # An id that is repeated many times gives one text; what lies behind the first 8,000 characters is learnt from too.
    rng = random.Random(4)
    kinds = {v: ["".join(rng.choices("abcdefghijklmnop" if v else "qrstuvwxyz", k=8)) for _ in range(80)] for v in (1, 0)}
    late = "".join(rng.choices("0123456789 ", k=8500))
    rows = [(1, "good words here"), (1, "good words here"), *((base + k, late + " ".join(rng.choices(kinds[v], k=900))) for v, base in ((1, 10), (0, 50)) for k in range(8))]
    docs = spark.createDataFrame(rows * 3, "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 50).cast("int").alias("quality"))
    model = quality_classifier.train(docs, labels)
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    assert min(got[10 + k] for k in range(8)) > max(got[50 + k] for k in range(8))


def without_repeats(rows):
    """(doc_id, bytes, SHA-256 of the bytes that no repeated window of 200 covers), by brute force."""
    count = collections.Counter(raw[i : i + 200] for _, raw in rows for i in range(len(raw) - 199))
    out = []
    for doc_id, raw in rows:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 199):
            if count[raw[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out.append((str(doc_id), len(raw), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("limit,batches,piece,apart", [(8192, None, 1 << 19, False), (2, 5, 700, True)])
def test_suffix_dedup(spark, odd, monkeypatch, limit, batches, piece, apart):
    rng = random.Random(3)
    base = "".join(rng.choice("abcd ") for _ in range(900))
    made = [extra(100 + i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 150))) + base[rng.randrange(300) : rng.randrange(450, 900)] + "é" * rng.randrange(150)) for i in range(50)]
    made += [extra(200 + k, t) for k, t in enumerate(["x" * 200, "xy" * 500 + "q", "yx" * 150, "z" * 199, "abc" * 67 + "q" * 300 + "abc" * 400, "xy" * 101, "p" * 230, "r" * 200 + "s" * 201, "r" * 200, base * 3])]
    made += [extra(204, "abc" * 67 + "q" * 300 + "abc" * 400)]
    frame = odd.where("doc_id is null or doc_id != 4").unionByName(spark.createDataFrame(made, SCHEMA))
    want = without_repeats([(r.doc_id, (r.text or "").encode()) for r in frame.collect()])
    monkeypatch.setattr(suffix_dedup, "LIMIT", limit)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    if apart:  # a batch of one row, so that its text is read in pieces
        frame = frame.repartition(200)
        monkeypatch.setattr(suffix_dedup, "BROADCAST_NUMBERS", 0)
    spans = suffix_dedup.repeated_spans
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda docs, scratch, text="text": spans(docs, scratch, text, batches))
    got = [(str(r.doc_id), r.n_bytes, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.remove_repeats(frame).collect()]
    assert sorted(got) == want


def test_suffix_dedup_of_a_long_periodic_text(spark):
    rng = random.Random(1)
    odd_text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400_000))
    docs = spark.createDataFrame([(1, "ab" * 2_500_000), (2, odd_text), (3, "tail " + odd_text[100_000:100_300])], "doc_id bigint, text string")
    got = {r.doc_id: [(x.a, x.b) for x in r.removed] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {1: [(0, 5_000_000)], 2: [(100_000, 100_300)], 3: [(5, 305)]}


def test_suffix_levels(spark):
    """Levels of 2, 1 and 1 batches after four; a batch's matches are found against all of them."""
    scratch = suffix_dedup.Scratch(spark, "levels")
    family = suffix_dedup.SuffixFamily(scratch, 4)
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdef", k=900)) for _ in range(4)]
    for k, text in enumerate(texts):
        own = spark.createDataFrame([(k, text + texts[0][:300] * (k == 3))], "doc_id bigint, text string")
        found = family.add(family.store(family.suffixes(suffix_dedup._texts(own, "text")).drop("batch"))[0])
        assert (found.count() > 0) == (k == 3)
    assert [size for size, _, _ in family.levels] == [2, 1, 1]
    family.close()


def test_suffix_dedup_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy(F.length("text")).limit(120).union(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 9 = 0 and length(text) < 6000"))
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    got = [(str(r.doc_id), r.n_bytes, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.remove_repeats(docs).collect()]
    assert sorted(got) == without_repeats(rows)
    found = suffix_dedup.op4_suffix_dedup(spark, SF)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and found.count() == 200


def test_simhash(spark, docs, odd):
    for frame, limit in ((docs, 16_384), (docs, 3), (odd, 16_384)):
        simhash.LIMIT = limit
        got = simhash.near_duplicates(frame).collect()
        fps = np.array([r.fp for r in got], np.int64).view(np.uint64)
        ids = np.array([2**62 if r.doc_id is None else r.doc_id for r in got])
        near, label = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4, ids.copy()
        while (now := np.array([label[row].min() for row in near])).tolist() != label.tolist():
            label = now
        assert [2**62 if r.component_id is None else r.component_id for r in got] == label.tolist()
    for _ in range(500):
        bits = sum(1 << i for i in random.sample(range(64), 4))
        assert any(m & bits == 0 for m in simhash.masks())


def removed_lines(rows, hashes):
    """Texts without the lines that an earlier one resembles, by (doc_id, text); None comes last, then texts go by hash."""
    seen, want = [], {}
    for doc_id, text in sorted(set(rows), key=lambda r: (2**63 - 1 if r[0] is None else r[0], hashes[r[1]])):
        kept = []
        for line in (text or "").split("\n"):
            own = frozenset(words(line))
            if not own or not any(5 * len(own & s) >= 4 * len(own | s) for s in seen):
                kept.append(line)
            if own:
                seen.append(own)
        want[doc_id, text] = None if text is None else "\n".join(kept)
    return collections.Counter((doc_id, want[doc_id, text]) for doc_id, text in rows)


def test_line_dedup(spark, docs, odd):
    clash = docs.selectExpr("doc_id", "text", "1 as _removed", "2 as _links", "3 as _of", "4 as _id", "5 as _th", "6 as row", "7 as th", "8 as removed")
    for frame, limit in ((docs, 16_384), (clash, 4), (odd, 16_384)):
        line_dedup.LIMIT = line_dedup.LINK_LIMIT = limit
        rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
        hashes = {r.text: r.h for r in frame.select("text", F.xxhash64("text").alias("h")).collect()}
        out = line_dedup.dedup_lines(frame)
        assert out.columns == frame.columns
        assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == removed_lines(rows, hashes)
    line_dedup.LIMIT, line_dedup.LINK_LIMIT = 16_384, 4096


def test_warc(spark):
    rows = [(1, "u", "x", 1), (2, "u", "x", 1), (3, None, None, 1), (4, "a b", "", 1), (5, "é", "日本" * 50_000, 1), (6, "u", "y", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, archive int")
    from intervalia.llm.common import Scratch

    base = Scratch(spark, "warc-test").base
    index = warc.normalise(warc.write_archives(warc.with_revisits(pages), f"{base}/plain"), f"{base}/plain", f"{base}/members").collect()
    got = {r.page_id: r for r in warc.read_records(spark.createDataFrame(index, "archive string, offset bigint, length bigint, error string"), f"{base}/members").collect()}
    for page_id, _, html, _ in rows:
        raw, r = (html or "").encode(), got[page_id]
        top = max(p for p, _, h, _ in rows if (h or "") == (html or ""))
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if top == page_id else ("revisit", top))
        assert r.payload is None or bytes(r.payload) == raw
    assert warc.write_archives(warc.with_revisits(pages.limit(0)), f"{base}/none").count() == 0


def test_warc_query(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    last = {}
    for page_id, raw in pages.items():
        last[raw] = max(page_id, last.get(raw, page_id))
    found = warc.op7_warc(spark, SF)
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = {(p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if last[raw] == p else "revisit", None if last[raw] == p else last[raw]) for p, raw in pages.items()}
    assert {tuple(r) for r in found.collect()} == want


def test_warc_rows_without_an_id_and_repeated_rows(spark, tmp_path):
    pages = spark.createDataFrame([(None, "u", "same"), (1, "u", "same"), (2, "u", "same"), (2, "u", "same"), (None, "v", "alone"), (None, "v", "alone")], "page_id bigint, url string, html string")
    scratch = warc.Scratch(spark, "warc-test")
    for s in (None, scratch):
        assert sorted((str(r.page_id), str(r.refers_to)) for r in warc.with_revisits(pages, s).collect()) == sorted([("None", "2"), ("1", "2"), ("2", "None"), ("2", "None"), ("None", "None"), ("None", "None")])


def test_foreign_archives(spark, tmp_path):
    import gzip
    import zlib

    plain = lambda head, block: b"\r\n".join([b"WARC/1.0", *head, b"Content-Length:%d" % len(block)]) + b"\r\n\r\n" + block + b"\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nContent-Type:text/html\r\n\r\n<p>hello</p>"
    one = plain([b"WARC-Type:warcinfo", b"WARC-Record-ID: <urn:uuid:1>"], b"software: x") + plain([b"WARC-Type: response", b"X-Long: first", b"  second", b"WARC-Record-ID:<urn:uuid:2>"], http)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one[:100]) + b"\0" * 7 + gzip.compress(one[100:]) + b"\0" * 3000)
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(one + one)[:-40])
    broken = bytearray(gzip.compress(one + one[:-30]))
    (tmp_path / "short.warc.gz").write_bytes(bytes(broken))
    (tmp_path / "noise.warc.gz").write_bytes(b"not gzip at all")
    names = spark.createDataFrame([(n,) for n in ("a", "b", "cut", "short", "noise")], "n string").selectExpr("concat(n, '.warc.gz') as archive")
    index = warc.normalise(names, f"file://{tmp_path}", f"file://{tmp_path}/out").cache()
    per = {n: sorted((r.offset is None for r in index.where(F.col("archive") == f"{n}.warc.gz").collect())) for n in ("a", "b", "cut", "short", "noise")}
    assert per["a"] == per["b"] == [False, False] and per["noise"] == [True]
    assert per["short"] == [False] * 3 + [True] and per["cut"][-1] and per["cut"].count(False) >= 1
    got = warc.read_records(index.where("error is null and archive in ('a.warc.gz', 'b.warc.gz')"), f"file://{tmp_path}/out").collect()
    assert sorted((r.record_type, bytes(r.payload)) for r in got) == sorted([("response", b"<p>hello</p>"), ("warcinfo", b"software: x")] * 2)
    assert all(r.page_id is None and r.payload_digest == base64.b32encode(hashlib.sha1(r.payload).digest()).decode() for r in got)
    first = index.where("archive = 'a.warc.gz' and offset = 0").first()
    raw = (tmp_path / "out" / "a.warc.gz").read_bytes()[: first.length]
    assert zlib.decompress(raw, 31).startswith(b"WARC/1.0")


def test_decontamination(spark, docs, odd):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    first = items.orderBy("item_id").first()
    changed = first.text.split()
    changed[3] = "instead"
    planted = spark.createDataFrame([extra(9001, "Before it. " * 30 + first.text + " and after it." * 30), extra(9002, " ".join(changed)), extra(9003, first.text[:60])], SCHEMA)
    frame = odd.unionByName(planted).unionByName(docs.select("doc_id", "text", *(F.lit(None).cast(t).alias(c) for c, t in odd.dtypes[2:])))
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(frame, items).collect()}
    assert {(9001, first.item_id), (9002, first.item_id)} <= got and not any(d == 9003 for d, _ in got)
    texts = {r.item_id: r.text.lower().split() for r in items.collect()}
    for r in docs.collect():
        own = " ".join(r.text.lower().split())
        for item_id, t in texts.items():
            if " ".join(t) in own:
                assert (r.doc_id, item_id) in got
    assert decontamination.find_leaks(docs, items.limit(0)).count() == 0
    assert decontamination.find_leaks(docs.limit(0), items).count() == 0


def test_empty_tables(docs):
    none = docs.limit(0)
    assert quality_rules.quality_rules(none).count() == 0
    assert token_counts.token_counts(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert bpe_codec.encode(none).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(row[j] + 1 if x == y else max(row[j + 1], now[j]))
        row = now
    return row[-1]


def covering(item, text):
    """The leak rule on every passage and its surroundings, by brute force."""
    own, all_words = item.lower().split(), text.lower().split()
    answer, size = decontamination.answer_of(item).lower().split(), 1 << len(item.split()).bit_length()
    for k in range(max(1, -(-(len(all_words) - size) // (size // 4)) + 1)):
        around = all_words[max(0, k * (size // 4) - size) : min(k * (size // 4) + size, len(all_words)) + size]
        covered = lcs(own, around) / len(own)
        if covered >= 0.8 or covered >= 0.6 and lcs(answer, around) / len(answer) >= 0.9:
            return True
    return False


def test_decontamination_recall(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()
    host = max((r.text for r in docs.collect() if r.text), key=lambda t: len(t.split())).split()
    rng, rows = random.Random(7), []
    for i, item in enumerate(items):
        for share in (0.2, 0.35):
            own = item.text.split()
            head = len(own) if share == 0.2 else max(1, len(own) - len(decontamination.answer_of(item.text).split()))
            for k in rng.sample(range(head), min(head, int(share * len(own)))):
                own[k] = f"other{rng.randrange(10**6)}"
            at = rng.randrange(0, max(1, len(host) - 400))
            around = host[at : at + 300] if i % 4 else ["unknown"] * 300  # some passages have no word of an item, but their surroundings do
            rows.append((2 * i + (share == 0.2), " ".join(around[:150] + own + around[150:])))
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(made, spark.createDataFrame(items)).collect()}
    want = {(d, item.item_id) for d, text in rows for item in items[max(0, d // 2 - 1) : d // 2 + 2] if covering(item.text, text)}
    assert len(want) > len(items) and want <= got
    assert got == {(d, i) for d, i in got if covering(next(x.text for x in items if x.item_id == i), dict(rows)[d])}


def test_decontamination_candidates_are_latent(spark, monkeypatch):
    """Without the latent cosine only items of a few words are found; a stricter one finds fewer leaks, never others."""
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    rng = random.Random(3)
    rows = []
    for r in items.collect():
        own = r.text.split()
        for k in rng.sample(range(len(own)), len(own) // 6):
            own[k] = f"other{rng.randrange(10**6)}"
        rows.append((r.item_id, " ".join(own)))
    made = spark.createDataFrame([*rows, (-1, "zebra yak xerus")], "doc_id bigint, text string")
    asked = items.unionByName(spark.createDataFrame([(-1, "zebra yak xerus")], "item_id bigint, text string"))

    def found(cosine):
        monkeypatch.setattr(decontamination, "LATENT_COSINE", cosine)
        return {(r.doc_id, r.item_id) for r in decontamination.find_leaks(made, asked).collect()}

    usual, strict, none = found(0.3), found(0.95), found(2.0)
    assert none == {(-1, -1)} and none < strict < usual and {(i, i) for i, _ in rows} <= usual


def test_short_lines(spark):
    rows = [(1, "Les.\na b\nx\n\none two three four"), (2, "Les.\nb a a\ny\n\none two three four five"), (3, "b\nfour three two one\na b c\none two three\nu v w x y"), (4, "u v w x")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: rows[0][1], 2: "y\n", 3: "b\na b c\none two three\nu v w x y", 4: ""}


def test_line_links(spark, docs):
    made = [(k, " ".join(["w%d" % j for j in range(12) if j != k])) for k in range(5)] + [(7, "w0 w1 w2 w3\nw0 w1 w2 w3 w4\n\nz"), (8, "z"), (None, None), (None, None), (0, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (0, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")]
    rng = random.Random(2)
    base = [f"b{k}" for k in range(40)]
    near = [(100 + k, " ".join(x if rng.random() > 0.12 else f"c{rng.randrange(60)}" for x in base)) for k in range(80)]
    for frame, limit in ((spark.createDataFrame(made, "doc_id bigint, text string"), 16_384), (spark.createDataFrame(near, "doc_id bigint, text string"), 16_384), (spark.createDataFrame(near, "doc_id bigint, text string"), 7), (docs, 16_384), (docs, 4)):
        line_dedup.LIMIT = line_dedup.LINK_LIMIT = limit
        lines = {(r.doc_id, i): frozenset(words(line)) for r in frame.collect() for i, line in enumerate((r.text or "").split("\n")) if words(line)}
        sets = set(lines.values())
        want = {key: sum(own != s and 5 * len(own & s) >= 4 * len(own | s) for s in sets) for key, own in lines.items()}
        rows = line_dedup.line_links(frame, line_dedup.Scratch(spark, "test")).collect()
        assert {(r.doc_id, x.line): x.links for r in rows for x in r.classes} == want and max(want.values()) > (frame is not docs)
        assert len({(lines[r.doc_id, x.line], x.cls) for r in rows for x in r.classes}) == len(sets) == len({x.cls for r in rows for x in r.classes})
        assert all(r.n_links == sum(x.links for x in r.classes) and r.n_removed == sum(x.removed for x in r.classes) for r in rows)
        assert len(rows) == frame.count()
    line_dedup.LIMIT, line_dedup.LINK_LIMIT = 16_384, 4096


def test_decontamination_long_short_and_nameless_items(spark):
    rng = random.Random(11)
    made = lambda n: " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(n))
    long, nameless, filler = made(2480) + ". " + made(20), made(20), made(300)
    items = spark.createDataFrame([(1, long), (2, "zebra yak xerus"), (None, nameless), (4, "lone")], "item_id bigint, text string")
    first, rest = " ".join(long.split()[:1100]), " ".join(long.split()[900:])
    rows = [(1, f"{filler} {long} {filler}"), (2, first), (3, f"{filler} {rest}"), (4, f"{filler} zebra yak  XERUS {filler}"), (5, "zebra yak and xerus"), (6, "zebra yak"), (7, "xerus"), (8, f"x {nameless}"), (9, "yak lone")]
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), items).collect()}
    assert got == {(1, 1), (3, 1), (4, 2), (8, None), (9, 4)}


CONTRACTS = {
    "op1_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op2_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op3_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op6_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op7_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op8_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_line_dedup": "doc_id bigint, n_lines bigint, n_removed bigint, n_links bigint",
    "op10_bpe_codec": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
}


@pytest.mark.parametrize("name", list(CONTRACTS))
def test_registered_query(spark, name):
    """Columns and their types, a row a document (page), and the values that a library or plain Python gives."""
    import zlib

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    from intervalia import llm

    found = llm.queries()[name](spark, SF)
    kinds = dict(found.dtypes)
    for column in CONTRACTS[name].split(", "):
        assert kinds[column.split()[0]] == column.split()[1]
    key = "page_id" if name == "op7_warc" else "doc_id"
    source = {r[0]: r[1] or "" for r in spark.read.parquet(f"{SF}/{'pages' if key == 'page_id' else 'documents'}.parquet").select(key, "html" if key == "page_id" else "text").collect()}
    rows = {r[key]: r for r in found.collect()}
    assert rows.keys() == source.keys()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    if name == "op2_token_counts":
        library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        assert all(rows[k].n_tokens == len(library.encode(t, add_special_tokens=False).ids) for k, t in source.items())
    if name == "op10_bpe_codec":
        with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.tiktoken_ranks(f.read()), special_tokens={})
        for k, t in source.items():
            ids = library.encode_ordinary(t)
            assert (rows[k].n_tokens, rows[k].ids_sha256, rows[k].decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode()))
    if name == "op6_simhash":
        prints = {k: simhash.fingerprint(t) & (2**64 - 1) for k, t in source.items()}
        root = {k: k for k in prints}
        while (new := {k: min(root[j] for j in prints if (prints[j] ^ prints[k]).bit_count() <= 4) for k in prints}) != root:
            root = new
        assert all((rows[k].fingerprint, rows[k].component_id) == (f"{prints[k]:016x}", root[k]) for k in prints)
    if name in ("op3_language_id", "op8_quality_classifier"):
        n, fold = (4, 2) if name == "op3_language_id" else (3, 1)
        assert all(r.held_out == (zlib.crc32(str(k).encode()) % n == fold) and 0 <= r.score <= 1 for k, r in rows.items())
    if name == "op9_line_dedup":
        want = removed_lines(list(source.items()), {t: 0 for t in source.values()})
        gone = {d: sum(bool(words(x)) for x in source[d].split("\n")) - sum(bool(words(x)) for x in (t or "").split("\n")) for d, t in want}
        assert all(r.n_removed == gone[k] and r.n_links == sum(x.links for x in r.classes) for k, r in rows.items())


def test_stages_of_empty_tables(spark, docs):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    none = docs.limit(0)
    assert decontamination.find_leaks(none, spark.read.parquet(f"{SF}/benchmark.parquet").limit(0)).count() == 0
    assert line_dedup.line_links(none, line_dedup.Scratch(spark, "none")).count() == 0
