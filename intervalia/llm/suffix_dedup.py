"""Operator 4, suffix-array dedup: removes every byte covered by a SPAN-byte string that starts anywhere else.

Suffixes are sampled: in each SPAN-byte window the GRAM-byte string with the smallest hash begins a suffix, its anchor, so equal
windows have one at the same place in them. A batch's suffix array holds its sampled suffixes in the order of their bytes: of
their first four, then of the hash of their first GRAM. It is dealt into buckets and sorted within each, and stored so. The index
is a logarithmic family of such arrays: a new batch is merge-scanned against every level (a merge join of arrays that are sorted
already, without a shuffle) for suffixes with the same first GRAM bytes, then becomes a level itself, and equal-sized levels merge before
the next batch, so a suffix is rewritten as often as the logarithm of the number of batches, which itself grows with the input.

Suffixes that match are then judged exactly, by 128-bit hashes. Equal surroundings (SIDE bytes on both sides) collapse to a class by
an aggregate: all windows of a class with two members are repeated. One member of each class of a key then brings its bytes, and for each place of
the anchor in a window the windows of different classes are compared. A key with over LIMIT classes is split, not compared in one task: a window
either has many bytes before the anchor or many behind it, so its rows are dealt by those bytes, again and again, until
groups are small or only one window is left, which needs no comparison. Texts that occur twice or more take part once, and go whole.

Texts of a short period (a letter repeated, say) would make an anchor a byte. Of a chain of anchors at equal distances the stretch is marked
as repeated at once, and only the anchors near its ends stay.

Edge cases: null and empty texts, and texts shorter than SPAN, keep all their bytes. Repeated rows are copies of each other, and go.
Rows with a null doc_id are treated alike. Very long texts are read PIECE bytes at a time. Extra columns are left out of the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, slices, table, utf8
from .words import _BASE, _power, mix

SPAN, GRAM = 200, 64
SIDE = SPAN - GRAM
#: Classes of one key that one task compares.
LIMIT = 8192
#: Bytes of a text that are read at once, of text for a bucket of the arrays, and of text for which a further batch is worth while.
PIECE, BUCKET_BYTES, BATCH_BYTES = 1 << 19, 32 << 20, 16 << 30
#: The longest period that is treated as such.
PERIOD = 32
#: Numbers that may be broadcast in lists of places (4 bytes each).
BROADCAST_NUMBERS = 8_000_000
_KEY = ["head", "key"]
_BASE2 = 0xD6E8FEB86659FD93


def _slide(x: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over each w neighbours: from the left within a block, from the right within a block."""
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.uint64(fill))
    padded[: len(x)] = x
    grid = padded.reshape(blocks, w)
    left = op.accumulate(grid, axis=1).ravel()
    right = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(x) - w + 1
    return op(right[:m], left[w - 1 : w - 1 + m])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Head, key, text and place in the text of each anchor; then text, from and to of each stretch of a short period."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64), none, none, none, none, none
    up, down = _power(n + 1)
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    h = mix((summed[GRAM:] - summed[:-GRAM]) * down[: n - GRAM + 1])
    least = _slide(h, SIDE + 1, np.minimum, 2**64 - 1)
    sizes = np.diff(offsets)
    inside = np.zeros(n + 1, np.int64)  # windows that lie in one text
    long = sizes >= SPAN
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, (offsets[1:] - SPAN + 1)[long], -1)
    least[np.cumsum(inside)[: len(least)] <= 0] = 0
    # An anchor is the smallest of one of the windows around it; of equal ones each is.
    side = np.zeros(SIDE, np.uint64)
    found = np.flatnonzero((_slide(np.concatenate([side, least, side]), SIDE + 1, np.maximum, 0) == h) & (h > 0))
    text = np.searchsorted(offsets, found, side="right") - 1
    keep, runs = _periods(data, h, found, text)
    own, a, b = (np.array(x, np.int64) for x in zip(*runs)) if runs else (none, none, none)
    found, text = found[keep], text[keep]
    four = np.zeros(len(found), np.uint32)
    for k in range(4):
        four = four << np.uint32(8) | data[found + k]
    return (four ^ np.uint32(1 << 31)).view(np.int32), h[found], text, found - offsets[text], own, a - offsets[own], b - offsets[own]


def _periods(data: np.ndarray, h: np.ndarray, found: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Which anchors stay, and (text, from, to) of the stretches that repeat themselves at a distance of up to PERIOD."""
    keep, runs = np.ones(len(found), bool), []
    if len(found) < 3:
        return keep, runs
    step = np.diff(found)
    link = (step <= PERIOD) & (text[1:] == text[:-1]) & (h[found[1:]] == h[found[:-1]])
    new = link.copy()
    new[1:] &= ~link[:-1] | (step[1:] != step[:-1])
    end = link.copy()
    end[:-1] &= ~link[1:] | (step[1:] != step[:-1])
    for i, j in zip(np.flatnonzero(new), np.flatnonzero(end) + 1):
        d, a, b = int(step[i]), int(found[i]), int(found[j]) + GRAM
        if b - a >= SPAN + d and np.array_equal(data[a : b - d], data[a + d : b]):
            runs.append((int(text[i]), a, b))
            keep[i + 1 : j + 1] = found[i + 1 : j + 1] > found[j] - SIDE - 2 * d
    return keep, runs


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, text and two hashes that tell it from others."""
    return docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text")).withColumns({"th": F.xxhash64("text"), "th2": F.xxhash64(F.lit(7), "text")})


class SuffixFamily:
    """Levels of sorted sparse suffix arrays (head, key, th, pos, run); the size of a level is its number of batches.

    Rows with run > 0 aren't suffixes but stretches of a short period, run bytes from pos on; their key is th2."""

    def __init__(self, scratch: Scratch, buckets: int):
        self.scratch, self.buckets = scratch, buckets
        self.levels: list[tuple[int, DataFrame, str]] = []
        self.stored: list[tuple[str, str]] = []

    def suffixes(self, texts: DataFrame, batches: int = 1) -> DataFrame:
        """The unsorted rows of texts (text, th, th2), with the batch that a text belongs to."""
        schema = "head int, key bigint, th bigint, pos int, run int, batch int"

        def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches_, "text"):
                data, offsets = utf8(part.column("text"))
                long = part.num_rows == 1 and len(data) > 2 * PIECE
                for lo in range(0, len(data) - SPAN + 1, PIECE) if long else [0]:
                    some = data[lo : lo + PIECE + SPAN - 1] if long else data
                    head, key, own, pos, r_own, a, b = anchors(some, np.array([0, len(some)]) if long else offsets)
                    of = pa.array(np.concatenate([own, r_own]))
                    th2 = part.column("th2").to_numpy()[r_own]
                    zero = np.zeros(len(own), np.int64)
                    columns = [np.concatenate([head, np.zeros(len(a), np.int32)]), np.concatenate([key.view(np.int64), th2])]
                    places = [np.concatenate(x).astype(np.int32) for x in ([pos + lo, a + lo], [zero, b - a])]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), part.column("th").take(of), *map(pa.array, places), part.column("batch").take(of)], names=["head", "key", "th", "pos", "run", "batch"])

        batch = F.pmod(F.xxhash64("th", F.lit(7)), F.lit(batches)).cast("int").alias("batch")
        return texts.select("text", "th", "th2", batch).mapInArrow(run, schema)

    def store(self, rows: DataFrame, by: list[str] = []) -> tuple[DataFrame, str]:
        """rows dealt into buckets by key and sorted within each, as a table in the shared folder."""
        name, path = f"suffixes_{uuid.uuid4().hex}", self.scratch.path()
        dealt = rows.repartition(self.buckets, *_KEY).dropDuplicates()
        writer = dealt.write.format("parquet").option("path", path).option("compression", "snappy").bucketBy(self.buckets, *_KEY).sortBy(*_KEY)
        (writer.partitionBy(*by) if by else writer).saveAsTable(name)
        self.stored.append((name, path))
        return self.scratch.spark.table(name), name

    def add(self, new: DataFrame) -> DataFrame:
        """Takes in a stored array; gives the keys that a suffix of it shares with another suffix."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a, a_name), (_, b, b_name) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * size, *self.store(a.unionByName(b))))
            self.drop(a_name)
            self.drop(b_name)
        place = F.struct("th", "pos")
        keys = lambda level: level.where("run = 0").select(*_KEY)
        found = new.where("run = 0").groupBy(*_KEY).agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select(*_KEY)
        for _, level, _ in self.levels:
            found = found.unionByName(keys(new).distinct().join(keys(level), _KEY, "left_semi"))
        self.levels.append((1, new, ""))
        return self.scratch.write(found)

    def matched(self, shared: DataFrame) -> DataFrame:
        """th and pos of the suffixes with these keys."""
        out = [level.where("run = 0").join(shared, _KEY, "left_semi").select("th", "pos") for _, level, _ in self.levels]
        return _union(out)

    def runs(self) -> DataFrame:
        """th, th2, a and b of the stretches of a short period."""
        out = _union([level.where("run > 0") for _, level, _ in self.levels])
        return out.select("th", F.col("key").alias("th2"), F.col("pos").alias("a"), F.expr("pos + run").alias("b"))

    def drop(self, name: str) -> None:
        for found, path in [x for x in self.stored if x[0] == name]:
            self.scratch.spark.sql(f"drop table if exists {found}")
            self.scratch.remove(path)
            self.stored.remove((found, path))

    def close(self) -> None:
        for name, _ in list(self.stored):
            self.drop(name)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _at_places(texts: DataFrame, places: DataFrame, schema: str, row) -> DataFrame:
    """row(bytes of the text, place) for each place (th, th2, rep and a list pos) of one copy of each text, behind th, th2 and pos."""
    few = (places.agg(F.sum(F.size("pos"))).first()[0] or 0) <= BROADCAST_NUMBERS
    mine = texts.join(F.broadcast(places) if few else places, ["th", "th2"]).where(F.col("doc_id").eqNullSafe(F.col("rep"))).select("text", "th", "th2", "pos")
    full = f"th bigint, th2 bigint, pos int, {schema}"
    names = [x.split()[0] for x in full.split(", ")]
    kinds = [{"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in full.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        for batch in slices(batches, "text", 1 << 19):
            for text, th, th2, where in zip(*(batch.column(c) for c in ("text", "th", "th2", "pos"))):
                raw, th, th2 = text.as_py().encode(), th.as_py(), th2.as_py()
                for p in where.values.to_pylist():
                    if p + GRAM <= len(raw):
                        rows.append((th, th2, p, *row(raw, p)))
                    if len(rows) >= 20_000:
                        yield out()
                        rows = []
        if rows:
            yield out()

    return mine.mapInArrow(run, full)


def _two(x: bytes, seed: int = 0) -> tuple[int, int]:
    found = xxhash.xxh3_128_intdigest(x, seed)
    return (found >> 64) - (1 << 63), (found & (1 << 64) - 1) - (1 << 63)


def _around(raw: bytes, p: int) -> tuple:
    """Hash of the anchor's first GRAM bytes, two of them with their surroundings, bytes before and behind."""
    n_left, n_right = min(SIDE, p), min(SIDE, len(raw) - p - GRAM)
    return (xxhash.xxh3_64_intdigest(raw[p : p + GRAM]) - (1 << 63), *_two(raw[p - n_left : p + SPAN], n_left), n_left, n_right)


def _bytes_around(raw: bytes, p: int) -> tuple:
    left, right = raw[max(0, p - SIDE) : p], raw[p + GRAM : p + SPAN]
    return (xxhash.xxh3_64_intdigest(raw[p : p + GRAM]) - (1 << 63), *_two(raw[p : p + GRAM]), len(left), len(right), left.rjust(SIDE, b"\0"), right.ljust(SIDE, b"\0"))


def _windows(left: np.ndarray, right: np.ndarray, salt: np.ndarray, base: int) -> np.ndarray:
    """Hash of the window with o bytes before the anchor, by o and row."""
    base = np.uint64(base)
    before, behind = np.zeros((SIDE + 1, len(salt)), np.uint64), np.zeros((SIDE + 1, len(salt)), np.uint64)
    for k in range(SIDE):
        before[k + 1] = before[k] * base + left[SIDE - 1 - k] + np.uint64(1)
        behind[k + 1] = behind[k] * base + right[k] + np.uint64(1)
    before += salt
    behind *= np.uint64(3)
    return mix(mix(before) + behind[::-1])


def _fixed(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SIDE).T)


_FOUND = "th bigint, th2 bigint, pos int, lo int, hi int"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of whole groups, each of LIMIT rows at most: the smallest and largest place of the anchor in a repeated window."""

    def judged(x: pa.Table) -> pa.RecordBatch:
        k1, k2 = (x[c].to_numpy().view(np.uint64) for c in ("k1", "k2"))
        left, right = _fixed(x["left"]), _fixed(x["right"])
        one, two = _windows(left, right, mix(k1), _BASE), _windows(left, right, mix(k2), _BASE2)
        n_left, n_right, least, most = (x[c].to_numpy() for c in ("n_left", "n_right", "lo", "hi"))
        lo, hi = np.full(len(k1), SIDE + 1, np.int32), np.full(len(k1), -1, np.int32)
        for o in range(SIDE + 1):
            rows = np.flatnonzero((o <= n_left) & (SIDE - o <= n_right) & (least <= o) & (o <= most))
            if len(rows) < 2:
                continue
            rows = rows[np.argsort(one[o, rows], kind="stable")]
            a, b = rows[1:], rows[:-1]
            same = (one[o, a] == one[o, b]) & (two[o, a] == two[o, b])
            twice = rows[np.append(same, False) | np.append(False, same)]
            lo[twice] = np.minimum(lo[twice], o)
            hi[twice] = o
        found = hi >= 0
        keep = x.select(["th", "th2", "pos"]).filter(pa.array(found)).combine_chunks()
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in keep.columns), pa.array(lo[found]), pa.array(hi[found])], names=["th", "th2", "pos", "lo", "hi"])

    def bounds(x: pa.Table) -> np.ndarray:
        a, b = x["k1"].to_numpy(), x["k2"].to_numpy()
        return np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1, [len(a)]])

    def whole(x: pa.Table, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
        lo = 0
        while lo < edge[-1]:
            hi = int(edge[max(np.searchsorted(edge, lo, side="right"), np.searchsorted(edge, lo + LIMIT, side="right") - 1)])
            yield judged(x.slice(lo, hi - lo))
            lo = hi

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 2 * LIMIT:
            x = pa.Table.from_batches(held).combine_chunks()
            edge = bounds(x)
            yield from whole(x, edge[:-1])
            held = x.slice(edge[-2]).to_batches()
            rows = x.num_rows - edge[-2]
    if rows:
        x = pa.Table.from_batches(held).combine_chunks()
        yield from whole(x, bounds(x))


def _compared(rows: DataFrame, large: DataFrame | None, scratch: Scratch) -> DataFrame:
    """The repeated windows (see _FOUND) among rows: gram, k1 and k2 name a group, lo to hi are the places to look at. large: gram and
    size m of the groups that one task can't compare."""
    out = []
    while True:
        if large is not None:
            rows = scratch.write(rows.join(large, "gram", "left"))
        small = rows if large is None else rows.where("m is null").drop("m")
        out.append(scratch.write(small.repartition("k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(_judge, _FOUND)))
        if large is None:
            return _union(out)
        hot = rows.where("m is not null").drop("m")
        # A group with one place left has the same window in all its rows.
        out.append(hot.where("lo = hi").select("th", "th2", "pos", "lo", "hi"))
        mid = F.expr("cast((lo + hi) div 2 as int)")
        halves = F.explode(F.array(F.struct(F.col("lo"), mid.alias("hi")), F.struct((mid + 1).alias("lo"), F.col("hi"))))
        # All windows of a half have at least lo bytes before the anchor, SIDE - hi behind it.
        shared = [F.expr(f"substring(left, {SIDE} - lo + 1, lo)"), F.expr(f"substring(right, 1, {SIDE} - hi)")]
        split = hot.where("lo < hi").withColumn("half", halves).withColumns({"lo": F.col("half.lo"), "hi": F.col("half.hi")}).drop("half").where(f"n_left >= lo and n_right >= {SIDE} - hi")
        keys = {"gram": F.xxhash64("gram", "lo", *shared), "k1": F.xxhash64("k1", "k2", "lo", *shared), "k2": F.xxhash64(F.lit(7), "k2", "k1", "lo", *shared)}
        rows = scratch.write(split.withColumns(keys))
        large = scratch.write(rows.groupBy("gram").agg(F.count("*").alias("m")).where(F.col("m") > LIMIT))
        large = None if large.isEmpty() else large


def repeated_spans(docs: DataFrame, scratch: Scratch, text: str = "text", batches: int | None = None) -> DataFrame:
    """th, th2 and spans (from, to; merged, in order) of every text with repeated bytes; a null list is the whole text."""
    texts = _texts(docs, text)
    once = scratch.write(texts.groupBy("th", "th2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size")).where(f"size >= {SPAN}"))
    total = once.agg(F.sum(F.col("size").cast("bigint"))).first()[0] or 0
    batches = batches or 4 + int(1 + total // BATCH_BYTES).bit_length() - 1
    family = SuffixFamily(scratch, min(100_000, max(8, total // BUCKET_BYTES)))  # Spark's most buckets
    arrays, _ = family.store(family.suffixes(texts, batches), ["batch"])
    shared = _union([family.add(arrays.where(F.col("batch") == b).drop("batch")) for b in range(batches)])
    listed = family.matched(shared.distinct()).groupBy("th").agg(F.collect_set("pos").alias("pos"))  # places in one text
    places = scratch.write(listed.join(once.select("th", "th2", "rep"), "th"))
    spans = [scratch.write(family.runs())]
    family.close()

    around = scratch.write(_at_places(texts, places, "gram bigint, c1 bigint, c2 bigint, n_left int, n_right int", _around))
    one = F.struct("th", "th2", "pos")
    classes = scratch.write(around.groupBy("gram", "c1", "c2").agg(F.min(one).alias("a"), F.max(one).alias("b")))
    # Equal surroundings: every window around the anchor is repeated.
    equal = around.where(f"n_left + n_right >= {SIDE}").join(classes.where("a != b").select("gram", "c1", "c2"), ["gram", "c1", "c2"], "left_semi")
    spans.append(scratch.write(equal.select("th", "th2", F.expr(f"greatest(0, pos - {SIDE})").alias("a"), F.expr(f"pos + {GRAM} + n_right").alias("b"))))
    scratch.drop(around)
    # Different surroundings of a key: one of each is compared.
    several = scratch.write(classes.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1"))
    stand = classes.join(several.select("gram"), "gram", "left_semi").select("a.*").groupBy("th", "th2").agg(F.collect_list("pos").alias("pos"))
    listed = scratch.write(stand.join(once.select("th", "th2", "rep"), ["th", "th2"]))
    rows = _at_places(texts, listed, "gram bigint, k1 bigint, k2 bigint, n_left int, n_right int, left binary, right binary", _bytes_around)
    large = several.where(F.col("m") > LIMIT)
    found = _compared(rows.withColumns({"lo": F.lit(0), "hi": F.lit(SIDE)}), None if large.isEmpty() else large, scratch)
    spans.append(found.select("th", "th2", F.expr("pos - hi").alias("a"), F.expr(f"pos - lo + {SPAN}").alias("b")))

    by_text = Window.partitionBy("th", "th2").orderBy("a", "b")
    apart = F.col("a") > F.max("b").over(by_text.rowsBetween(Window.unboundedPreceding, -1))
    islands = _union(spans).withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(by_text))
    merged = islands.groupBy("th", "th2", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    lists = merged.groupBy("th", "th2").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))
    copies = once.where("n > 1").select("th", "th2", F.lit(None).cast("array<struct<a:int,b:int>>").alias("spans"))
    some = lists.join(copies.select("th", "th2"), ["th", "th2"], "left_anti")
    return scratch.write(some.unionByName(copies))


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, removed (spans of bytes that go) and kept (the bytes that stay)."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    spans = repeated_spans(docs, scratch, text)
    few = (spans.agg(F.sum(F.coalesce(2 * F.size("spans"), F.lit(1)))).first()[0] or 0) <= BROADCAST_NUMBERS
    marked = spans.withColumn("mark", F.lit(True))
    both = _texts(docs, text).join(F.broadcast(marked) if few else marked, ["th", "th2"], "left").select("doc_id", "text", "spans", "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes, gone, kept = [], [], []
            for text_, spans_, mark in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "mark"))):
                raw = text_.encode()
                own = [] if not mark else [(0, len(raw))] if spans_ is None else [(s["a"], s["b"]) for s in spans_]
                edges = [0, *(e for s in own for e in s), len(raw)]
                sizes.append(len(raw))
                gone.append([{"a": a, "b": b} for a, b in own])
                kept.append(b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
            spans_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, spans_type), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return both.mapInArrow(run, "doc_id bigint, n_bytes bigint, removed array<struct<a:int,b:int>>, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", n_removed.cast("bigint").alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
