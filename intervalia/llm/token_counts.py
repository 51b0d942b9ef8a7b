"""Operator 2, token counts without token lists: two deterministic transducers and a parallel prefix scan.

The first transducer reads characters, classed as letter, number, blank or other, and marks where pieces begin. A batch
of texts is cut into equal chunks, without regard to its texts; each chunk's map from every state to the state behind it
is found for all chunks at once, the maps are composed by a parallel prefix scan, and each chunk is then read
again from its true first state. The second transducer reads the bytes of pieces and annotates each transition with the
change in the number of tokens of the prefix read so far. Its states are compiled as they are first met, from the
prefix dynamic programme in bpe.py: a state is the longest suffix that may go on as a token, with the last tokens and the
relative counts of the prefixes behind which a token may still be open. All pieces of a batch advance together, one byte a step.
A piece of over PIECE_CHUNK bytes is cut into chunks that advance side by side, too: each begins in the state that a short stretch
before it leads to, and gives its last state and the tokens it emits. Where that first state is the last one of the chunk before, as it nearly
always is since old context is forgotten within a few tokens, the chunks' maps compose and their counts add up; a chunk whose guess was wrong
is read again from the true state, so the count is exact. Compiled states are dropped, but for those in use, beyond MOST_STATES.

Edge cases: null and empty texts have no bytes and no tokens. A special token's string inside a text counts as one
token, as is the library's default. Repeated rows are counted one by one. Extra columns pass through; the three new
columns replace input columns of the same name. A text and a piece of any length are read whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .bpe import Bpe, json_vocabulary
from .bpe_codec import _read, vocabulary_file
from .common import slices, table, utf8

VOCABULARY = "byte_bpe_50k.json"
#: Compiled states of the second transducer that a worker keeps between batches (about 1 kB each).
MOST_STATES = 200_000
#: Characters in a chunk of the first transducer; bytes in one of the second, and before it, from which its first state is guessed.
CHUNK = 256
PIECE_CHUNK, WARM = 1024, 256

LETTER, NUMBER, OTHER, BLANK, SPACE = range(5)
#: States: what the last character was, or that a contraction goes on; FRESH is the start of a text.
FRESH, CUT1, CUT2 = 5, 6, 7
N_STATES = 8


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        out[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
    out[32] = SPACE
    return out


@functools.lru_cache(maxsize=1)
def piece_transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and mark, by symbol and state. A symbol is a class, whether a non-blank follows in the text, whether the
    text begins here, and the length of a contraction that could begin here (0, 2 or 3)."""
    step, mark = np.zeros((60, N_STATES), np.uint8), np.zeros((60, N_STATES), bool)
    for symbol in range(60):
        kind, (follows, first, short) = symbol % 5, (symbol // 5 % 2, symbol // 10 % 2, symbol // 20)
        for state in range(N_STATES):
            was = FRESH if first else state
            if was in (CUT1, CUT2):
                step[symbol, state] = CUT1 if was == CUT2 else FRESH  # behind a contraction a piece begins
                continue
            if kind in (BLANK, SPACE):
                begins = was not in (BLANK, SPACE) or bool(follows)
            else:
                begins = was in (FRESH, BLANK) or was != SPACE and was != kind
            mark[symbol, state] = begins
            step[symbol, state] = (CUT2 if short == 2 else CUT1) if short and begins else kind
    return step, mark


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and where each begins."""
    if not (data & 0x80).any():
        return data, np.arange(len(data))
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    out, padded = lead.copy(), np.concatenate([data, np.zeros(3, np.uint8)])
    for low, high, n in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3), (0xF0, 0x100, 4)):
        own = np.flatnonzero((lead >= low) & (lead < high))
        value = lead[own] & (0x7F >> n)
        for k in range(1, n):
            value = (value << 6) | (padded[at[own] + k] & 0x3F)
        out[own] = value
    return out, at


def piece_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Which characters begin a piece. firsts: where texts begin, each at a character of its own."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[firsts], first[n] = True, True
    blank = kind >= BLANK
    follows = np.append(~blank[1:], False) & ~first[1:]
    symbol = kind + 5 * follows + 10 * first[:-1]
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        padded, ends = np.append(points, [0, 0]), np.append(first, [True])
        a, b = padded[quotes + 1], padded[quotes + 2]
        in1 = ~ends[quotes + 1]
        in2 = in1 & ~ends[quotes + 2]
        two = in1 & np.isin(a, [ord(c) for c in "stmd"])
        three = in2 & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        symbol[quotes] += 20 * two.astype(np.uint8) + 40 * (three & ~two).astype(np.uint8)
    # A contraction of 2 leaves one character (CUT1), one of 3 leaves two (CUT2).
    step, mark = piece_transducer()
    lanes = -(-n // CHUNK)
    grid = np.zeros(lanes * CHUNK, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(lanes, CHUNK).T).astype(np.int16) * N_STATES
    flat = step.ravel()
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (lanes, 1))
    for k in range(CHUNK):
        maps = flat[grid[k][:, None] + maps]
    reach = 1
    while reach < lanes:  # inclusive scan: each map becomes that of all chunks up to its own
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].copy(), axis=1)
        reach *= 2
    state = np.concatenate([[FRESH], maps[:-1, FRESH]]).astype(np.uint8)
    marks, out = mark.ravel(), np.empty((CHUNK, lanes), bool)
    for k in range(CHUNK):
        at = grid[k] + state
        out[k] = marks[at]
        state = flat[at]
    return out.T.ravel()[:n]


class CountTransducer:
    """step[state, column]: the next state, or -1 where it isn't compiled yet; emit[state, column]: change in tokens.

    Bytes get columns as they are first met, since most corpora use under half of them."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.clear()

    def clear(self) -> None:
        self.keys: list[tuple] = []
        self.known: dict[tuple, int] = {}
        self.width, self.bytes = 128, b""
        self.column = np.full(256, -1, np.int64)
        self.step, self.emit = np.full((1024, self.width), -1, np.int32), np.zeros((1024, self.width), np.int8)
        self.state((b"", ((0, b"", 0),)))

    def state(self, key: tuple) -> int:
        if (found := self.known.get(key)) is None:
            found = self.known[key] = len(self.keys)
            self.keys.append(key)
            if found >= len(self.step):
                self.step = np.concatenate([self.step, np.full_like(self.step, -1)])
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
        return found

    def columns(self, data: np.ndarray) -> np.ndarray:
        for byte in np.flatnonzero(np.bincount(data, minlength=256)):
            if self.column[byte] < 0:
                self.column[byte] = len(self.bytes)
                self.bytes += bytes([byte])
        if len(self.bytes) > self.width:
            more = ((0, 0), (0, 256 - self.width))
            self.step, self.emit, self.width = np.pad(self.step, more, constant_values=-1), np.pad(self.emit, more), 256
        return self.column[data]

    def compile(self, state: int, column: int) -> None:
        suffix, opens = self.keys[state]
        suffix += self.bytes[column : column + 1]
        size, best = len(suffix), None
        kept = []
        for back, last, count in opens:  # back: bytes from where a token may begin to the end
            tail = suffix[size - back - 1 :]
            if best is None and tail in self.bpe.ids and self.bpe.valid(last, tail):
                best = (tail, count + 1)
            if tail in self.bpe.prefixes:
                kept.append((back + 1, last, count))
        token, count = best
        kept = [(back, last, c - count) for back, last, c in kept]
        longest = kept[0][0] if kept else 0
        at = self.state((suffix[size - longest :], (*kept, (0, token, 0))))
        self.step[state, column], self.emit[state, column] = at, count

    def compact(self, state: np.ndarray) -> np.ndarray:
        """Drops all states but the first and those in use; gives their new numbers."""
        alive, at = np.unique(state, return_inverse=True)
        keys = [self.keys[0], *(self.keys[x] for x in alive)]
        self.keys, self.known = [], {}
        self.step, self.emit = np.full((1024, self.width), -1, np.int32), np.zeros((1024, self.width), np.int8)
        return np.array([self.state(k) for k in keys][1:], np.int64)[at]

    def run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last state of each stretch data[start:start + length] of columns, read from its state, and the tokens emitted."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, state = starts[order], lengths[order], state[order]
        total = np.zeros(len(order), np.int64)
        alive = len(order) - np.cumsum(np.bincount(lengths, minlength=1))  # stretches longer than k
        for k in range(int(lengths[0]) if len(lengths) else 0):
            m = alive[k]
            if len(self.keys) > MOST_STATES:
                state = self.compact(state)
            at = state[:m] * self.width + data[starts[:m] + k]
            to = self.step.ravel()[at]
            if (new := to < 0).any():
                for x in np.unique(at[new]):
                    self.compile(*divmod(int(x), self.width))
                to = self.step.ravel()[at]
            total[:m] += self.emit.ravel()[at]
            state[:m] = to
        last, out = np.empty_like(state), np.empty_like(total)
        last[order], out[order] = state, total
        return last, out

    def count(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each piece."""
        if len(self.keys) > MOST_STATES:
            self.clear()
        data = self.columns(data)
        long = lengths > PIECE_CHUNK
        out = np.zeros(len(starts), np.int64)
        out[~long] = self.run(data, starts[~long], lengths[~long], np.zeros(int((~long).sum()), np.int64))[1]
        for i in np.flatnonzero(long):
            out[i] = self._long(data[starts[i] : starts[i] + lengths[i]])
        return out

    def _long(self, data: np.ndarray) -> int:
        """Tokens of one long piece, its chunks side by side."""
        starts = np.arange(0, len(data), PIECE_CHUNK)
        lengths = np.minimum(PIECE_CHUNK, len(data) - starts)
        none = np.zeros(len(starts), np.int64)
        warm = np.minimum(WARM, starts)
        guess = [self.keys[x] for x in self.run(data, starts - warm, warm, none.copy())[0]]  # by key, as numbers may change
        last, total = self.run(data, starts, lengths, np.array([self.state(k) for k in guess]))
        ends = [self.keys[x] for x in last]
        for i in range(1, len(starts)):
            if guess[i] != ends[i - 1]:
                at, n = self.run(data, starts[i : i + 1], lengths[i : i + 1], np.array([self.state(ends[i - 1])]))
                ends[i], total[i] = self.keys[int(at[0])], n[0]
        return int(total.sum())


@functools.lru_cache(maxsize=1)
def compiled(raw: bytes) -> tuple[CountTransducer, list[bytes]]:
    ids, merges, added = json_vocabulary(raw)
    return CountTransducer(Bpe(ids, merges)), [a.encode() for a in added]


def counts(transducer: CountTransducer, added: list[bytes], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens of each text; text i is data[offsets[i]:offsets[i + 1]]."""
    n = len(offsets) - 1
    total, owner = np.zeros(n, np.int64), np.arange(n)
    whole = data.tobytes()
    if any(a in whole for a in added):
        cut, parts, owner, bounds = regex.compile(b"|".join(map(regex.escape, added))), [], [], [0]
        for i in range(n):
            text = whole[offsets[i] : offsets[i + 1]]
            found = cut.split(text)
            total[i] += len(found) - 1
            for part in found:
                parts.append(part)
                owner.append(i)
                bounds.append(bounds[-1] + len(part))
        data, offsets, owner = np.frombuffer(b"".join(parts), np.uint8), np.array(bounds), np.array(owner)
    if not len(data):
        return total
    points, at = code_points(data)
    texts = offsets[:-1][np.diff(offsets) > 0]
    starts = at[piece_starts(points, np.searchsorted(at, texts))]
    lengths = np.diff(np.append(starts, len(data)))
    per_piece = transducer.count(data, starts, lengths)
    summed = np.concatenate([[0], np.cumsum(per_piece)])
    edge = np.searchsorted(starts, offsets)
    np.add.at(total, owner, summed[edge[1:]] - summed[edge[:-1]])
    return total


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str | None = None, limit: int = 512) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit."""
    raw = docs.sparkSession.sparkContext.broadcast(_read(vocabulary or vocabulary_file(VOCABULARY)))
    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    keep = docs.drop(*(f.name for f in new if f.name != text))
    schema = T.StructType([*keep.schema.fields, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer, added = compiled(raw.value)
        for batch in slices(batches, text):
            data, offsets = utf8(batch.column(text))
            n = counts(transducer, added, data, offsets)
            columns = [*batch.columns, pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *(f.name for f in new)])

    return keep.mapInArrow(run, schema)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
