"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a piece has exactly one token that may end it: the last token of the prefix's own encoding. It is
found among the vocabulary's tokens that end there as the one that forms a valid pair with the last token of what is
left. Two tokens are a valid pair if merging their bytes by rank gives the two tokens back; an encoding whose
neighbours are all valid pairs is the encoding. Storing the last token of each prefix makes appends exact and cheap, and an
edit needs new values only until they agree with the old ones over the longest token's length.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import ahocorasick

#: Entries at which a worker's memo of pairs is emptied; it bounds memory, not results.
MEMO = 500_000
NEVER = 1 << 60


def tiktoken_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies in JSON stand for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def json_vocabulary(raw: bytes) -> tuple[dict[bytes, int], dict[tuple[bytes, bytes], int], list[str]]:
    """Ids by bytes, ranks of merged pairs, and the strings of added tokens, from a tokenizers file."""
    spec = json.loads(raw)
    letters = byte_letters()
    to_bytes = lambda s: bytes(letters[c] for c in s)
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    added = [t["content"] for t in spec["added_tokens"]]
    ids = {to_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    return ids, {(to_bytes(a), to_bytes(b)): r for r, (a, b) in enumerate(merges)}, added


class Bpe:
    """ids: token ids by bytes. merges: ranks of pairs; without it a pair's rank is that of its joined bytes."""

    def __init__(self, ids: dict[bytes, int], merges: dict[tuple[bytes, bytes], int] | None = None):
        self.ids = ids
        self.merges = merges
        self.longest = max(map(len, ids))
        self.prefixes = {t[:k] for t in ids for k in range(1, len(t))}
        self._valid: dict[tuple[bytes, bytes], bool] = {}
        self._automaton: ahocorasick.Automaton | None = None
        self._halves: dict[bytes, tuple[bytes, bytes, int]] = {}
        self._whole: dict[bytes, bool] = {}

    def merged(self, piece: bytes, below: int = NEVER) -> list[bytes]:
        """The encoding by repeated merging, for short pieces; only merges of a rank under below."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            pairs = zip(parts, parts[1:])
            if self.merges is None:
                rank, at = min((self.ids.get(a + b, NEVER), i) for i, (a, b) in enumerate(pairs))
            else:
                rank, at = min((self.merges.get(p, NEVER), i) for i, p in enumerate(pairs))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def rank(self, left: bytes, right: bytes) -> int:
        if self.merges is None:
            return self.ids.get(left + right, NEVER)
        return self.merges.get((left, right), NEVER)

    def halves(self, token: bytes) -> tuple[bytes, bytes, int]:
        """The two parts that merge last into a token, with the rank of that merge; a byte has none."""
        if (known := self._halves.get(token)) is None:
            if len(token) == 1:
                known = (b"", b"", -1)
            elif self.merges is None:
                left, right = self.merged(token, self.ids[token])
                known = (left, right, self.ids[token])
            else:
                known = next(((token[:k], token[k:], r) for k in range(1, len(token)) if (r := self.merges.get((token[:k], token[k:]))) is not None and self.merged(token, r) == [token[:k], token[k:]]))
            self._halves[token] = known
        return known

    def whole(self, token: bytes) -> bool:
        """Whether merging a token's own bytes gives the token."""
        if (known := self._whole.get(token)) is None:
            known = self._whole[token] = self.merged(token) == [token]
        return known

    def valid(self, left: bytes, right: bytes) -> bool:
        """left may stand before right; an empty left is the start.

        Takes back the merges on both sides of the border, latest first. The pair is wrong if, among the parts that
        ever touch at the border, two would have merged before the later of them was made into something larger.
        """
        key = (left, right)
        if (known := self._valid.get(key)) is None:
            if len(self._valid) > MEMO:
                self._valid.clear()
            known = self._valid[key] = self.whole(right) and (not left or self._apart(left, right))
        return known

    def _apart(self, a: bytes, b: bytes) -> bool:
        before = NEVER  # a merge of a and b had to come before this one, which made the larger part
        inclusive = False
        while True:
            rank = self.rank(a, b)
            if rank < before or inclusive and rank == before != NEVER:
                return False
            _, a_end, a_rank = self.halves(a)
            b_start, _, b_rank = self.halves(b)
            if a_rank < 0 and b_rank < 0:
                return True
            # Of equal ranks the left merge comes first, so the right one is taken back first.
            if a_rank > b_rank:
                a, before, inclusive = a_end, a_rank, False
            else:
                b, before, inclusive = b_start, b_rank, True

    @property
    def automaton(self) -> ahocorasick.Automaton:
        """Finds the tokens that end at each byte, the longest first."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for token in self.ids:
                self._automaton.add_word(token.decode("latin-1"), token)
            self._automaton.make_automaton()
        return self._automaton

    def walk(self, piece: bytes, last: list[bytes]) -> Iterator[int]:
        """Appends to last (of all shorter prefixes; last[0] is empty) the token that ends each further prefix; yields its end."""
        done, valid = len(last), self._valid
        low = max(0, done - self.longest)
        for end, token in self.automaton.iter(piece[low:].decode("latin-1")):
            end += low + 1
            if end < done:
                continue
            if end > done:
                raise ValueError("the vocabulary lacks a single byte")
            before = last[end - len(token)]
            known = valid.get((before, token))
            if known or known is None and self.valid(before, token):
                last.append(token)
                done += 1
                yield end


class Prefixes:
    """The last token of every prefix of a piece, kept through appends and edits."""

    def __init__(self, bpe: Bpe, piece: bytes = b""):
        self.bpe, self.piece, self.last = bpe, b"", [b""]
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        for _ in self.bpe.walk(self.piece, self.last):
            pass

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replaces piece[start:stop]; returns how many prefixes were encoded anew."""
        old, shift = self.last, start + len(new) - stop
        self.piece = self.piece[:start] + new + self.piece[stop:]
        self.last, same = old[: start + 1], 0
        for end in self.bpe.walk(self.piece, self.last):
            same = same + 1 if end > start + len(new) and self.last[end] == old[end - shift] else 0
            if same > self.bpe.longest:  # each later value depends only on so many before it
                self.last += old[end - shift + 1 :]
                return end - start
        return len(self.piece) - start

    def tokens(self) -> list[bytes]:
        out, end = [], len(self.piece)
        while end:
            out.append(self.last[end])
            end -= len(out[-1])
        return out[::-1]

    def ids(self) -> list[int]:
        return [self.bpe.ids[t] for t in self.tokens()]
