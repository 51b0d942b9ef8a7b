"""Operator 12, periodic runs of words, found on a grammar.

A run is a stretch of consecutive words with smallest period q (words q apart are equal), at least max(LEAST, TIMES * q) long, that no neighbouring word extends.
The texts of a portion become word ids, and Re-Pair turns them into a grammar: in each round every pair that stands at two places or more and is more
frequent than the pairs that overlap it becomes a new symbol. A run lies whole in some symbol whose two halves it crosses, or in the string of symbols that is left of a text. So runs are
looked for at the boundary of each symbol once, whatever the number of its places; those found are carried to all places at which the symbol was
formed, and at the boundaries of what is left. Pieces of a run that were found in symbols smaller than it merge with it.

At a boundary a run of period q reaches at least half of TIMES * q to the right or to the left, so that some words there (half of q, four at least) stand again q words on.
Such anchors are compared by hashes, scale by scale, and each candidate is extended by a binary search on prefix hashes modulo two primes.
Of candidates with the same stretch the smallest period is the run's.

A portion is PORTION_BYTES of text or one longer text; memory grows with that. Edge cases: null and empty texts have no words and no runs. Repeated rows are worked on one by one. A null doc_id stays null. An
empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, utf8
from .words import mix, word_hashes

LEAST, TIMES = 24, 3
PORTION_BYTES = 1 << 20
#: Shortest anchor; anchors of length A find periods from 2 * A on, under 4 * A (the shortest one: all under 4 * A).
ANCHOR = 4
#: Candidates that are extended at once.
_MOST = 1 << 20
_PRIMES = ((1 << 31) - 1, (1 << 31) - 19)


@dataclass
class Boundaries:
    """Where runs are looked for: lo <= boundary < hi, and the places to which what is found is carried."""

    lo: np.ndarray
    at: np.ndarray
    hi: np.ndarray
    #: Of the i-th boundary: shifts[edge[i]:edge[i + 1]].
    edge: np.ndarray
    shifts: np.ndarray


def _first_of(order_key: np.ndarray) -> np.ndarray:
    new = np.ones(len(order_key), bool)
    new[1:] = order_key[1:] != order_key[:-1]
    return new


def grammar(ids: np.ndarray, text: np.ndarray) -> Boundaries:
    """Re-Pair over ids; pairs don't cross texts (text[i] is the text of word i).

    A symbol has the place of its first word; behind and before link it with its neighbours. A pair that is found once stays so until one of its symbols
    changes, and is looked at again only then."""
    n_words = len(ids)
    symbol, own = np.append(ids.astype(np.int64), 0), np.append(text, -1)
    behind, before = np.arange(1, n_words + 2), np.arange(-1, n_words)
    starts, looked_at = np.ones(n_words, bool), np.ones(n_words, bool)
    n_symbols = int(symbol.max()) + 1
    los, ats, his, counts, shifts = [], [], [], [], []
    while True:
        live = np.flatnonzero(looked_at)
        live = live[own[live] == own[behind[live]]]
        key = symbol[live] * n_symbols + symbol[behind[live]]
        touch = np.append(False, behind[live[:-1]] == live[1:])  # the pair before overlaps this one
        # Of equal pairs that overlap (a a a) every other one counts.
        same = touch & ~_first_of(key)
        place = np.arange(len(key))
        odd = (place - np.maximum.accumulate(np.where(same, 0, place))) % 2 == 1
        counted = np.flatnonzero(~odd)
        order = counted[np.argsort(key[counted])]
        first = np.flatnonzero(_first_of(key[order]))
        n = np.diff(np.append(first, len(order)))
        kinds = len(first)
        # The most frequent pair comes first; of equally frequent ones that with the least hash, so that a round takes many.
        rank = np.full(kinds, kinds)
        repeated = np.flatnonzero(n > 1)
        rank[repeated[np.lexsort((mix(key[order[first[repeated]]].astype(np.uint64)), -n[repeated]))]] = np.arange(len(repeated))
        ranks = np.empty(len(key), np.int64)
        ranks[order] = np.repeat(rank, n)
        ranks[odd] = ranks[np.flatnonzero(odd) - 1]
        left = np.where(touch, np.append(kinds, ranks[:-1]), kinds)
        right = np.where(np.append(touch[1:], False), np.append(ranks[1:], kinds), kinds)
        at = np.flatnonzero((ranks < kinds) & ~odd & (ranks <= right) & ((ranks < left) | same))
        at = at[np.argsort(key[at])]
        first = np.flatnonzero(_first_of(key[at]))
        n = np.diff(np.append(first, len(at)))
        many = n > 1
        if not many.any():
            break
        looked_at[live[ranks == kinds]] = False
        at, n = live[at[np.repeat(many, n)]], n[many]
        one = at[np.cumsum(n) - n]
        middle = behind[at]
        end = behind[middle]
        size = behind[behind[one]] - one
        long = size >= LEAST
        if long.any():
            los.append(one[long])
            ats.append(behind[one[long]])
            his.append(one[long] + size[long])
            counts.append(n[long])
            shifts.append(at[np.repeat(long, n)] - np.repeat(one[long], n[long]))
        symbol[at] = np.repeat(n_symbols + np.arange(len(n)), n)
        n_symbols += len(n)
        behind[at] = end
        before[end] = at
        starts[middle] = looked_at[middle] = False
        looked_at[at] = True
        looked_at[before[at[before[at] >= 0]]] = True
    # What is left of each text.
    edge = np.flatnonzero(_first_of(text))
    end = np.append(edge[1:], n_words)
    start = np.flatnonzero(starts)
    which = np.searchsorted(edge, start, side="right") - 1
    inner = np.flatnonzero((start > edge[which]) & (end[which] - edge[which] >= LEAST))
    los.append(edge[which[inner]])
    ats.append(start[inner])
    his.append(end[which[inner]])
    counts.append(np.ones(len(inner), np.int64))
    shifts.append(np.zeros(len(inner), np.int64))
    joined = [np.concatenate(x).astype(np.int64) for x in (los, ats, his, counts, shifts)]
    return Boundaries(*joined[:3], np.concatenate([[0], np.cumsum(joined[3])]), joined[4])


class Words:
    """Word ids with hashes of all stretches."""

    def __init__(self, ids: np.ndarray):
        self.ids, n = ids, len(ids)
        rng = np.random.default_rng(12)
        self.sums, self.powers = [], []
        for p in _PRIMES:
            value = rng.integers(1, p, int(ids.max()) + 1 if n else 1)[ids]
            power = np.ones(n + 1, np.int64)
            base, done = int(rng.integers(1 << 20, p)), 1
            while done < n + 1:
                more = min(done, n + 1 - done)
                power[done : done + more] = power[:more] * pow(base, done, p) % p
                done += more
            self.powers.append(power)
            self.sums.append(np.concatenate([[0], np.cumsum(value * power[:n] % p)]) % p)

    def equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from i on and from j on are the same; i <= j."""
        same = np.ones(len(i), bool)
        for p, power, total in zip(_PRIMES, self.powers, self.sums):
            same &= ((total[i + n] - total[i]) % p * power[j - i] - (total[j + n] - total[j])) % p == 0
        return same

    def ahead(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on, at most so many; i <= j."""
        return self._search(lambda n: self.equal(i, j, n), most)

    def behind(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The same for the words before i and j."""
        return self._search(lambda n: self.equal(i - n, j - n, n), most)

    @staticmethod
    def _search(same, most: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(most), most.copy()
        while (lo < hi).any():
            middle = (lo + hi + 1) // 2
            good = same(middle)
            lo, hi = np.where(good, middle, lo), np.where(good, hi, middle - 1)
        return lo


def crossing(words: Words, b: Boundaries) -> tuple[np.ndarray, ...]:
    """Boundary, start, end and period of the runs that cross each boundary, inside lo and hi."""
    n = len(words.ids)
    out: list[tuple[np.ndarray, ...]] = []
    longest = int((b.hi - b.lo).max()) if len(b.lo) else 0
    names, alive, size, anchor = words.ids.astype(np.int64), np.arange(n), 1, ANCHOR
    while longest:
        while size < anchor:
            names, alive = _doubled(names, alive, size)
            size *= 2
        low = 1 if anchor == ANCHOR else 2 * anchor
        if TIMES * low > longest or not len(alive):
            break
        key = names[alive] * (4 * n) + alive  # sorted by name, then place; windows of 4 * anchor words don't reach the next name
        key.sort()
        for right in (True, False):
            here = b.at if right else b.at - anchor
            inside = np.flatnonzero((here >= b.lo) & (here + anchor <= b.hi))
            inside = inside[names[here[inside]] >= 0]
            at = here[inside]
            base = names[at] * (4 * n) + at
            if right:
                lo, hi = base + low, base + np.minimum(4 * anchor, b.hi[inside] - anchor - at + 1)
            else:
                lo, hi = base - np.minimum(4 * anchor - 1, at - b.lo[inside]), base - low + 1
            from_, to = np.searchsorted(key, lo), np.searchsorted(key, np.maximum(lo, hi))
            total = np.concatenate([[0], np.cumsum(to - from_)])
            done = 0
            while done < len(inside):
                upto = max(done + 1, int(np.searchsorted(total, total[done] + _MOST, side="right")) - 1)
                m = (to - from_)[done:upto]
                which = np.repeat(np.arange(done, upto), m)
                other = key[np.repeat(from_[done:upto] - (np.cumsum(m) - m), m) + np.arange(m.sum())] - names[at[which]] * (4 * n)
                out.append(_extended(words, b, inside[which], np.abs(other - at[which]), right))
                done = upto
        anchor *= 2
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    k, start, end, q = (np.concatenate(c) for c in zip(*out))
    order = np.lexsort((q, end, start, k))
    k, start, end, q = k[order], start[order], end[order], q[order]
    new = _first_of(k) | _first_of(start) | _first_of(end)
    return k[new], start[new], end[new], q[new]


def _doubled(names: np.ndarray, alive: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of stretches twice as long, and where they begin; those found once only have name -1."""
    n = len(names)
    begin = alive[alive + 2 * size <= n]
    begin = begin[names[begin + size] >= 0]
    key = names[begin] * (n + 1) + names[begin + size]
    _, name, count = np.unique(key, return_inverse=True, return_counts=True)
    many = count[name] > 1
    out = np.full(n, -1, np.int64)
    out[begin[many]] = name[many]
    return out, begin[many]


def _extended(words: Words, b: Boundaries, k: np.ndarray, q: np.ndarray, right: bool) -> tuple[np.ndarray, ...]:
    """The stretches of these periods at boundaries k, where they are runs: from the words at the boundary and q on, or from those q before."""
    at, lo, hi = b.at[k], b.lo[k], b.hi[k]
    point = at if right else at - q
    start = point - words.behind(point, point + q, point - lo)
    end = point + words.ahead(point, point + q, hi - q - point) + q
    good = (start < at) & (end > at) & (end - start >= np.maximum(LEAST, TIMES * q))
    return k[good], start[good], end[good], q[good]


def find_runs(ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, end and period of all runs, by text, start and period; starts and ends count words of all texts together."""
    if len(ids) < LEAST:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    b = grammar(ids, text)
    k, start, end, q = crossing(Words(ids), b)
    times = b.edge[k + 1] - b.edge[k]
    shift = b.shifts[np.repeat(b.edge[k] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
    start, end, q = np.repeat(start, times) + shift, np.repeat(end, times) + shift, np.repeat(q, times)
    order = np.lexsort((-end, start, q, text[start] if len(start) else start))
    start, end, q = start[order], end[order], q[order]
    # Pieces of one run have its period and lie in it.
    of = text[start]
    group = np.cumsum(_first_of(of) | _first_of(q)) if len(start) else start
    far = len(ids) + 1
    reach = np.maximum.accumulate(end + group * far)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] + group[1:] * far > reach[:-1] - q[1:]
    first = np.flatnonzero(new)
    end = np.maximum.reduceat(end, first) if len(first) else end
    start, q, of = start[first], q[first], of[first]
    order = np.lexsort((q, start, of))
    return of[order], start[order], end[order], q[order]


_RUN = "struct<start: bigint, length: bigint, period: bigint>"


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, the words that stay, with one blank between them; a word goes if a run
    holds it after the run's first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, PORTION_BYTES):
            data, offsets = utf8(batch.column(text))
            hashes, first, behind = word_hashes(data, offsets)
            edge = np.searchsorted(first, offsets)
            n = np.diff(edge)
            own = np.repeat(np.arange(len(n)), n)
            of, start, end, q = find_runs(np.unique(hashes, return_inverse=True)[1], own)
            gone = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(gone, start + q, 1)
            np.add.at(gone, end, -1)
            keep = np.cumsum(gone[:-1]) == 0
            raw = data.tobytes()
            collapsed = []
            for i in range(len(n)):
                lo, hi = edge[i], edge[i + 1]
                words = raw[offsets[i] : offsets[i + 1]].split() if hi > lo else []
                collapsed.append(b" ".join(words if keep[lo:hi].all() else [w for w, k in zip(words, keep[lo:hi].tolist()) if k]).decode())
            fields = [pa.array(c) for c in (start - edge[of], end - start, q)]
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(n) + 1)).astype(np.int32)), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), runs, pa.array(collapsed, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id bigint, n_words bigint, runs array<{_RUN}>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; in texts of n words whose h = crc32(doc_id) is divisible by 10, each word i from a on is original word a + (i - a) % p, with g = h / 10,
    a = g % n and p = 1 + (n - a) / (3 + g % 8). Texts without an id stay as they are."""
    chosen = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h")).withColumn("g", F.expr("h div 10"))
    words = r"filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x != '')"
    return chosen.selectExpr(
        "doc_id",
        f"""case when h % 10 != 0 or h is null or text is null then text else
        transform(array({words}), w -> if(size(w) = 0, '', transform(array(struct(cast(g % size(w) as int) as a, size(w) as n)), y ->
          array_join(transform(sequence(0, y.n - 1), i -> get(w, if(i < y.a, i, y.a + (i - y.a) % cast((y.n - y.a) div (3 + g % 8) + 1 as int)))), ' '))[0]))[0] end as text""",
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    more = "x.length * a.period > a.length * x.period or (x.length * a.period = a.length * x.period and (x.start < a.start or (x.start = a.start and x.period < a.period)))"
    best = F.expr(f"aggregate(runs, get(runs, 0), (a, x) -> if({more}, x, a))")
    lines = "array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\\n')), '')"
    return found.withColumn("best", best).selectExpr(
        "doc_id", "cast(size(runs) as bigint) as n_runs", "best.start as start", "best.length as length", "best.period as period", "1000 * best.length div best.period as exponent_milli",
        f"sha2(cast({lines} as binary), 256) as runs_sha256", "sha2(cast(collapsed as binary), 256) as collapsed_sha256",
    )
