"""Operator 9, line dedup: an exact set-similarity self-join of lines.

A line is the set of its words. Words are ordered by rarity (their bucket's count over all documents, then their hash; any
fixed order gives the same result, a rare one is fast). A line sends the first n - ceil(0.8 n) + 1 words, its prefix, with its
size, their places, the word before each and a parity map of the whole set (128 bits, or folded to 64 for lines of up to NARROW words, where that is
enough); lines that are similar meet at a prefix word. Length, place and parity filters drop pairs that cannot reach a Jaccard similarity
of 0.8, and pairs with the same word before this one, which meet there too. What is left isn't written as pairs: a line that has any
partner at a word goes on to the second step, with its words, once for that word. There each pair is verified, at the first
place in the order at which it meets, and each line gets the number of its links and learns whether one leads to an earlier line. So the work tables grow with the
lines, though a group of near copies has as many links as pairs. A line is removed if an earlier one (by doc_id, then place in the text) has a
similarity of 0.8 or more, be that line removed itself or not.

Equal lines collapse to a class before the join. Runs of a prefix word over LIMIT lines are worked on block by block (runs.py), and so
are those of the second step.

Edge cases: sets of under LEAST words resemble equal ones only, which the classes find; blank lines stay. A null text is
one without lines, and stays null. Rows with a null doc_id come last. Rows equal in doc_id and text are one document and keep the same
lines; other texts under the same doc_id follow by the text's hash. Words are compared by 64-bit hashes, sets by those and their parity maps.
Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, table, utf8
from .runs import by_runs
from .words import mix, word_hashes

#: The similarity as a fraction, smallest set that is judged, buckets of the rarity table, rows of a run.
NUM, DEN = 4, 5
MIN_WORDS = 1
#: The least size of a set that a different one can resemble (four words and five share 0.8); smaller ones have no prefix.
LEAST = 4
BUCKETS = 1 << 16
#: Stands for a null doc_id, which comes last.
LAST = 2**63 - 1
#: Stands for the word before a line's first one.
NONE = -(1 << 40)
#: Words up to which a line's parity map has 64 bits; a longer line's has LANES times as many.
NARROW = 48
LANES = 2
MAP = [f"m{k}" for k in range(LANES)]
LIMIT = 16_384
#: The same where lines come with their words.
LINK_LIMIT = 4096
#: Rows of a few numbers each that may be broadcast (about 40 MB).
BROADCAST_ROWS = 1_000_000


def _rarity(docs: DataFrame, text: str) -> np.ndarray:
    """Rank of each bucket of words, the rarest first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, text):
            hashes, _, _ = word_hashes(*utf8(batch.column(text)))
            total += np.bincount((hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    found = docs.select(text).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    out = np.zeros(BUCKETS, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    rank = np.empty(BUCKETS, np.uint64)
    rank[np.argsort(out, kind="stable")] = np.arange(BUCKETS, dtype=np.uint64)
    return rank


def _order(line: np.ndarray, rank: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Sorts by line, rank and hash; by one number of 64 bits where that tells all words apart."""
    if len(line) and line[-1] < 1 << 16:
        key = line.astype(np.uint64) << np.uint64(48) | rank << np.uint64(32) | hashes >> np.uint64(32)
        order = np.argsort(key)
        key, hashes_ = key[order], hashes[order]
        if not ((key[1:] == key[:-1]) & (hashes_[1:] != hashes_[:-1])).any():
            return order
    return np.lexsort((hashes, rank, line))


def line_sets(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, line in the text, where each line's words begin (one more than lines) and the different words of lines with a
    word, in the order of rank (of a word's bucket), then of their hashes."""
    hashes, start, _ = word_hashes(data, offsets)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    own = np.searchsorted(offsets, start, side="right") - 1
    line = breaks[start] + own
    order = _order(line, rank[(hashes % np.uint64(BUCKETS)).astype(np.int64)], hashes)
    hashes, line, own = hashes[order], line[order], own[order]
    new = np.ones(len(line), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])
    hashes, line, own = hashes[new], line[new], own[new]
    head = np.ones(len(line), bool)
    head[1:] = line[1:] != line[:-1]
    at = np.flatnonzero(head)
    return own[at], line[at] - own[at] - breaks[offsets[own[at]]], np.append(at, len(line)), hashes


def parity_maps(words: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The lanes of each line's parity map. The lanes of a short line are folded into the first, so that the lanes' XOR is
    the 64-bit map of every line."""
    bit, lane = np.uint64(1) << ((words >> np.uint64(56)) & np.uint64(63)), (words >> np.uint64(62)) % np.uint64(LANES)
    lanes = [np.bitwise_xor.reduceat(np.where(lane == k, bit, np.uint64(0)), at[:-1]) for k in range(LANES)]
    narrow = np.diff(at) <= NARROW
    lanes[0] = np.where(narrow, np.bitwise_xor.reduce(lanes), lanes[0])
    return [lanes[0], *(np.where(narrow, np.uint64(0), x) for x in lanes[1:])]


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(text).alias("th"), F.col(text).alias("text"))


def _lines(docs: DataFrame, text: str, rarity: np.ndarray) -> DataFrame:
    """doc_id, th, line, n, cls (hash of the set), parity map and prefix of each line that is judged."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            own, line, at, words = line_sets(*utf8(batch.column("text")), shared.value)
            if not len(own):
                continue
            size = np.diff(at)
            of = np.repeat(np.arange(len(size)), size)
            maps = parity_maps(words, at)
            cls = mix(np.add.reduceat(mix(words), at[:-1]) + size.astype(np.uint64))
            place = np.arange(len(words)) - at[of]
            kept = size >= MIN_WORDS
            prefix = np.where(size >= LEAST, size - (NUM * size + DEN - 1) // DEN + 1, 0)
            inside = place < prefix[of]
            ends = np.concatenate([[0], np.cumsum(prefix[kept])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((words[inside] >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            take = pa.array(own[kept])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(line[kept].astype(np.int32)), pa.array(size[kept].astype(np.int32)), pa.array(cls[kept].view(np.int64)), *(pa.array(m[kept].view(np.int64)) for m in maps), lists],
                names=["doc_id", "th", "line", "n", "cls", *MAP, "prefix"],
            )

    return _keyed(docs, text).mapInArrow(run, f"doc_id bigint, th bigint, line int, n int, cls bigint, {', '.join(f'{m} bigint' for m in MAP)}, prefix array<int>")


def _words_of(docs: DataFrame, text: str, rarity: np.ndarray, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """o, words, in order, and place (d, th, line) of the wanted lines (doc_id, th, line, o)."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)
    lists = scratch.write(wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("line", "o")).alias("want")))  # lines of one document
    d = _keyed(docs, text)
    few = lists.agg(F.coalesce(F.sum(F.size("want")), F.lit(0))).first()[0] <= BROADCAST_ROWS
    lists = F.broadcast(lists) if few else lists
    mine = (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    both = d.join(lists.withColumnRenamed("doc_id", "_id").withColumnRenamed("th", "_th"), mine).select("text", F.coalesce("doc_id", F.lit(LAST)).alias("d"), "th", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            lines, rows = [], []
            for text_, d_, th, want in zip(*(batch.column(c).to_pylist() for c in ("text", "d", "th", "want"))):
                parts = text_.split("\n")
                for x in want:
                    lines.append(parts[x["line"]])
                    rows.append((x["o"], d_, th, x["line"]))
            own, _, at, words = line_sets(*utf8(pa.array(lines, pa.string())), shared.value)
            assert len(own) == len(rows)  # wanted lines have words
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(words.view(np.int64)))], names=["o", "d", "th", "line", "words"])

    return both.mapInArrow(run, "o bigint, d bigint, th bigint, line int, words array<bigint>")  # repeated rows give a line twice


def need(na, nb):
    """Words that two sets of these sizes share at least, if similar."""
    return (NUM * (na + nb) + NUM + DEN - 1) // (NUM + DEN)


def meeting(columns: dict[str, np.ndarray], bounds: np.ndarray) -> list[np.ndarray]:
    """The lines of each run, sorted by size, that may resemble another one of it, unless they meet at the word before as well."""
    o, n, pos, before = columns["o"], columns["at"] >> 32, columns["at"] & 0xFFFFFFFF, columns["before"]
    lanes = [columns[m].view(np.uint64) for m in MAP]
    fold = np.bitwise_xor.reduce(lanes)
    begin = np.repeat(bounds[:-1], np.diff(bounds))
    meets = np.zeros(len(o), bool)
    at, back = np.arange(len(o)), 0
    while True:
        back += 1
        at = at[at - back >= begin[at]]
        at = at[DEN * n[at - back] >= NUM * n[at]]  # the next one back is smaller still
        if not len(at):
            return [columns["w"][meets], o[meets]]
        a = at - back
        most = n[a] + n[at] - 2 * need(n[a], n[at])
        ok = (np.bitwise_count(fold[a] ^ fold[at]) <= most) & ((before[a] != before[at]) | (before[a] == NONE)) & (o[a] != o[at])
        a, b, most = a[ok], at[ok], most[ok]
        ok = np.minimum(n[a] - pos[a], n[b] - pos[b]) >= need(n[a], n[b])
        a, b, most = a[ok], b[ok], most[ok]
        narrow = np.minimum(n[a], n[b]) <= NARROW
        ok = narrow | (sum(np.bitwise_count(m[a] ^ m[b]).astype(np.int64) for m in lanes) <= most)
        meets[a[ok]] = True
        meets[b[ok]] = True


def _short(words: np.ndarray) -> np.ndarray:
    """The 32 bits of a word by which lines meet."""
    return (words >> np.uint64(32)).astype(np.uint32).view(np.int32).astype(np.int64)


class Group:
    """Whole groups of lines that meet at a word w; verifies their pairs."""

    def __init__(self, x: pa.Table):
        self.o, self.i, self.j, self.own, w = (x[c].to_numpy() for c in ("o", "i", "j", "own", "w"))
        self.rank = np.empty(len(w), np.int64)
        self.rank[np.lexsort([x[c].to_numpy() for c in ("line", "th", "d")])] = np.arange(len(w))
        lists = x["words"].combine_chunks()
        self.start = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.to_numpy().view(np.uint64)[self.start[0] : self.start[-1]]
        self.start = self.start - self.start[0]
        self.n = np.diff(self.start)
        short = _short(words)
        row = np.repeat(np.arange(len(w)), self.n)
        first = np.flatnonzero(short == w[row])
        self.pos = np.zeros(len(w), np.int64)
        self.pos[row[first[::-1]]] = (first - self.start[row[first]])[::-1]
        known, self.word = np.unique(words, return_inverse=True)
        known32, self.short = np.unique(short, return_inverse=True)
        self.prefix = self.n - (NUM * self.n + DEN - 1) // DEN + 1
        self.marks, self.early = np.zeros(len(known), np.int32), np.zeros(len(known32), bool)
        key = np.stack([w, self.i, self.j])
        self.bounds = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [len(w)]])

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each line its number of links, and whether one leads to an earlier line."""
        links, after = np.zeros(len(self.o), np.int64), np.zeros(len(self.o), bool)
        size = np.diff(self.bounds)
        two = self.bounds[:-1][size == 2]
        likely = self._similar(two)
        apart = (self.i[two] == self.j[two]) | (self.own[two] != self.own[two + 1])
        first = likely & apart & (self.pos[two] == 0) & (self.n[two + 1] - self.pos[two + 1] >= need(self.n[two], self.n[two + 1]))  # and can't have met before
        links[two[first]] = links[two[first] + 1] = 1
        later = self.rank[two] < self.rank[two + 1]
        after[two[first & later] + 1] = after[two[first & ~later]] = True
        rest = np.concatenate([two[likely & ~first], self.bounds[:-1][size > 2]])
        for lo, n in zip(rest.tolist(), np.concatenate([np.full(int((likely & ~first).sum()), 2), size[size > 2]]).tolist()):
            hi = lo + n
            for a in range(lo, hi - 1):
                b = self._partners(a, hi)
                if len(b):
                    links[a] += len(b)
                    links[b] += 1
                    later = self.rank[b] > self.rank[a]
                    after[b] |= later
                    after[a] |= not later.all()
        return links, after

    def _similar(self, a: np.ndarray) -> np.ndarray:
        """Whether lines a and the ones behind them are similar, for all at once."""
        if not len(a):
            return np.zeros(0, bool)

        def keys(rows: np.ndarray) -> np.ndarray:
            n = self.n[rows]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            return np.repeat(np.arange(len(rows)), n) * len(self.marks) + self.word[np.repeat(self.start[rows], n) + place]

        mine, theirs = np.sort(keys(a)), keys(a + 1)
        n = self.n[a + 1]
        found = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
        return np.add.reduceat(found.astype(np.int64), np.cumsum(n) - n) >= need(self.n[a], n)

    def _partners(self, a: int, hi: int) -> np.ndarray:
        own = self.word[self.start[a] : self.start[a + 1]]
        self.marks[own] = 1
        rest = self.start[a + 1 : hi]
        shared = np.add.reduceat(self.marks[self.word[rest[0] : self.start[hi]]], rest - rest[0])
        self.marks[own] = 0
        n_a, pos, n = self.n[a], self.pos[a], self.n[a + 1 : hi]
        least = need(n_a, n)
        # Similar, met at this word, and of different blocks if those of two blocks are compared.
        ok = (shared >= least) & (np.minimum(n_a - pos, n - self.pos[a + 1 : hi]) >= least)
        if self.i[a] != self.j[a]:
            ok &= self.own[a + 1 : hi] != self.own[a]
        b = a + 1 + np.flatnonzero(ok)
        if not len(b) or not pos:
            return b
        # Not if they have met before: at an earlier word of a that is in b's prefix, and at a place where the filters let it pass.
        head = self.short[self.start[a] : self.start[a] + pos]
        self.early[head] = True
        size = self.prefix[b]
        edge = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(edge, size)
        met = self.early[self.short[np.repeat(self.start[b], size) + place]] & (place <= np.repeat(self.n[b] - need(n_a, self.n[b]), size))
        self.early[head] = False
        return b[~np.logical_or.reduceat(met, edge)]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines sorted by group (w, i, j) and o: o, links and after of those that have a link."""

    def judged(x: pa.Table) -> pa.RecordBatch:
        group = Group(x)
        links, after = group.links()
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(group.o[some]), pa.array(links[some]), pa.array(after[some])], names=["o", "links", "after"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 2 * LINK_LIMIT:
            x = pa.Table.from_batches(held).combine_chunks()
            w, i, j = (x[c].to_numpy() for c in ("w", "i", "j"))
            last = np.flatnonzero((w[1:] != w[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
            if len(last):
                cut = int(last[-1]) + 1
                yield judged(x.slice(0, cut))
                held, rows = x.slice(cut).to_batches(), x.num_rows - cut
            else:
                held = x.to_batches()
    if rows:
        yield judged(pa.Table.from_batches(held).combine_chunks())


def judged_lines(docs: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """doc_id, th, line and class (cls) of every line with a word, with same (an equal set came earlier), after (its class resembles one
    that came earlier) and links: how many other classes resemble its class."""
    rarity = _rarity(docs, text)
    lines = scratch.write(_lines(docs, text, rarity))
    order = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("d"), "th", "line", "doc_id")
    cls = ["cls", "n", *MAP]
    classes = lines.groupBy(*cls).agg(F.min(order).alias("x"), F.first("prefix").alias("prefix"))
    classes = scratch.write(classes.withColumn("o", F.monotonically_increasing_id()))
    # n and the word's place travel in one number.
    w = F.col("w").cast("bigint")
    before = F.when(F.col("pos") > 0, F.expr("element_at(prefix, if(pos > 0, pos, 1))").cast("bigint")).otherwise(NONE)
    rows = classes.select("o", "n", "prefix", *MAP, F.posexplode("prefix").alias("pos", "w")).select(w.alias("w"), "o", (F.shiftleft(F.col("n").cast("bigint"), 32) + F.col("pos")).alias("at"), before.alias("before"), *MAP)
    meets = by_runs(rows, ["w"], meeting, ["w", "o"], scratch, LIMIT, order=["at"])
    linked = _linked(docs, text, rarity, classes.select("o", "x"), scratch.write(meets.distinct()), scratch)
    judged = classes.join(linked, "o", "left").select(*cls, "x", F.coalesce("after", F.lit(False)).alias("after"), F.coalesce("links", F.lit(0)).alias("links"))
    joined = lines.drop("prefix").join(judged, cls)
    later = order.cast("struct<d:bigint,th:bigint,line:int,doc_id:bigint>") > F.col("x")
    return joined.select("doc_id", "th", "line", "cls", later.alias("same"), "after", "links")


def _linked(docs: DataFrame, text: str, rarity: np.ndarray, classes: DataFrame, meets: DataFrame, scratch: Scratch) -> DataFrame:
    """o, links and after of the classes that have a link; meets tells which class (o) meets others at which word (w)."""
    wanted = classes.join(meets.select("o").distinct(), "o").select(F.col("x.doc_id").alias("doc_id"), F.col("x.th").alias("th"), F.col("x.line").alias("line"), "o")
    stored = scratch.write(_words_of(docs, text, rarity, wanted, scratch))
    words = stored.dropDuplicates(["o"])
    zero = F.lit(0).cast("bigint")
    hot = scratch.write(meets.groupBy("w").agg(F.ceil(F.count("*") / LINK_LIMIT).cast("bigint").alias("blocks")).where("blocks > 1"))
    if hot.isEmpty():
        dealt = meets.withColumns({"own": zero, "i": zero, "j": zero})
    else:
        own = F.pmod(F.xxhash64("o"), F.coalesce("blocks", F.lit(1)))
        other = F.explode(F.sequence(zero, F.coalesce("blocks", F.lit(1)) - 1))
        dealt = meets.join(hot, "w", "left").withColumn("own", own).withColumn("other", other).select("w", "o", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    both = dealt.join(words, "o").select("w", "i", "j", "own", "o", "d", "th", "line", "words")
    found = both.repartition("w", "i", "j").sortWithinPartitions("w", "i", "j", "o").mapInArrow(_verify, "o bigint, links bigint, after boolean")
    out = scratch.write(found.groupBy("o").agg(F.sum("links").alias("links"), F.bool_or("after").alias("after")))
    scratch.drop(stored)
    return out


def dedup_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the lines that an earlier line resembles."""
    gone = judged_lines(docs, Scratch(docs.sparkSession, "lines"), text).where("same or after")
    gone = gone.groupBy("doc_id", "th").agg(F.collect_set("line").alias("removed")).select(F.col("doc_id").alias("id"), F.col("th").alias("of"), "removed")
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64(text).alias("th"))
    found = whole.join(gone, (F.col("th") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")), "left").select("row", "removed")
    own = F.col("row").getField(text)
    numbered = F.transform(F.split(own, "\n"), lambda line, i: F.struct(line.alias("line"), i.alias("i")))
    kept = F.array_join(F.transform(F.filter(numbered, lambda x: ~F.array_contains("removed", x.i)), lambda x: x.line), "\n")
    return found.select(*(F.when(F.col("removed").isNull(), own).otherwise(kept).alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its lines with a word and how many go; classes has each line's class id (a hash of its set of words), the
    number of other classes that resemble it, be they earlier or later, and whether the line goes. n_links sums these numbers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_links(docs, Scratch(spark, "lines"))


def line_links(docs: DataFrame, scratch: Scratch) -> DataFrame:
    slim = docs.select("doc_id", F.xxhash64("text").alias("th"), F.expr(r"cast(coalesce(size(filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')), 0) as bigint)").alias("n_lines"))
    line = F.struct("line", "cls", "links", F.expr("same or after").alias("removed"))
    found = judged_lines(docs, scratch).groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.sort_array(F.collect_set(line)).alias("classes"))
    both = slim.join(found, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    n_removed = F.expr("cast(coalesce(size(filter(classes, x -> x.removed)), 0) as bigint)")
    n_links = F.expr("coalesce(aggregate(classes, 0L, (n, x) -> n + x.links), 0L)")
    none = F.expr("cast(array() as array<struct<line:int,cls:bigint,links:bigint,removed:boolean>>)")
    return both.select("doc_id", "n_lines", n_removed.alias("n_removed"), n_links.alias("n_links"), F.coalesce("classes", none).alias("classes"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)
