"""Operator 11, licence scans by fuzzy search for short notices.

A text is read as words: A-Z lower-cased, every other ASCII character that isn't a letter or digit ends a word, and one blank stands between words. A notice of m characters may
differ by k edits (inserted, deleted or changed characters). Cut into k + 1 pieces, at least one of them stands unchanged in every such place (pigeonhole). One
automaton finds all pieces of all notices in one reading of the text. Around each piece found, a window that holds every place the piece can belong to goes to the regex library,
whose bounded-error matching gives the span with the fewest edits that begins and ends at word borders, or none. Phrases (k = 0) have themselves as their only piece, and all
their places are reported; of overlapping spans of another notice the one with the fewest edits is, then the first.

Work is in proportion to the text and the pieces found in it; what was found in a window is kept for MEMO equal windows at most. Edge cases: a null text is empty. A null doc_id stays null, and
repeated rows are scanned one by one. An empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

MEMO = 4096
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


@dataclass(frozen=True)
class Notice:
    label: str
    words: str
    edits: int

    @property
    def base(self) -> bool:
        return not self.edits


def notice(label: str, words: str) -> Notice:
    """A tenth of its characters may differ, at most six."""
    return Notice(label, words, min(6, len(words) // 10))


#: Phrases of the contract, searched exactly, and well-known short notices.
PHRASES = (Notice("mit", "mit license", 0), Notice("apache", "apache license", 0), Notice("gpl", "general public license", 0))
NOTICES = (
    *PHRASES,
    notice("mit", "released under the mit license"),
    notice("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    notice("apache", "licensed under the apache license version 2 0"),
    notice("gpl", "licensed under the gnu general public license"),
    notice("lgpl", "gnu lesser general public license"),
    notice("agpl", "gnu affero general public license"),
    notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    notice("isc", "permission to use copy modify and or distribute this software for any purpose"),
    notice("mpl", "subject to the terms of the mozilla public license"),
    notice("unlicense", "this is free and unencumbered software released into the public domain"),
    notice("cc-by-nc", "licensed under cc by nc"),
    notice("cc-by", "creative commons attribution"),
    notice("cc0", "cc0 1 0 universal"),
    notice("reserved", "all rights reserved"),
)


def normal(text: str | None) -> str:
    """The words with one blank before, between and behind them; without words one blank."""
    words = (text or "").encode().translate(_WORDS).split()
    return (b" ".join([b"", *words, b""]) if words else b" ").decode()


class Scanner:
    """Finds notices in normal texts."""

    def __init__(self, notices: tuple[Notice, ...]):
        self.notices = notices
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(notices):
            cuts = [len(n.words) * i // (n.edits + 1) for i in range(n.edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(n.words[a:b], []).append((k, a))
        self.pieces = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.pieces.add_word(piece, (len(piece), where))
        self.pieces.make_automaton()
        self.patterns = [regex.compile(f"(?b)(?<= )(?:{regex.escape(n.words)}){{e<={n.edits}}}(?= )") for n in notices]
        self.verified = lru_cache(MEMO)(self._verified)

    def _verified(self, k: int, window: str) -> tuple[int, int, int] | None:
        m = self.patterns[k].search(window)
        return m and (*m.span(), sum(m.fuzzy_counts))

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """Notice, first character, character behind, and edits, by place."""
        found: list[set[tuple[int, int, int]]] = [set() for _ in self.notices]
        for last, (length, where) in self.pieces.iter(text):
            for k, offset in where:
                n = self.notices[k]
                at = last + 1 - length - offset
                lo = max(0, at - n.edits - 1)
                if m := self.verified(k, text[lo : at + len(n.words) + 2 * n.edits + 1]):
                    found[k].add((m[2], lo + m[0], lo + m[1]))
        out = []
        for k, own in enumerate(found):
            if self.notices[k].base:
                out += [(k, a, b, e) for e, a, b in own]
                continue
            taken: list[tuple[int, int, int]] = []
            group: list[tuple[int, int, int]] = []
            end = -1
            for e, a, b in sorted(own, key=lambda x: x[1:]):  # groups of overlapping spans
                if a >= end and group:
                    taken.append(min(group))
                    group = []
                group.append((e, a, b))
                end = max(end, b)
            taken += [min(group)] if group else []
            out += [(k, a, b, e) for e, a, b in taken]
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


_SPAN = "struct<label: string, phrase: boolean, first: bigint, words: bigint, edits: int, likeness: double, text: string>"


def find_notices(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, text: str = "text") -> DataFrame:
    """doc_id, n_words and spans, by place: label, phrase (whether an exact phrase), first word (from 0), words, edits, likeness
    (1 less edits a character of the notice) and the words found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        kind = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("first", pa.int64()), ("words", pa.int64()), ("edits", pa.int32()), ("likeness", pa.float64()), ("text", pa.string())]))
        for batch in slices(batches, text):
            n_words, rows = [], []
            for t in batch.column(text).to_pylist():
                plain = normal(t)
                n_words.append(plain.count(" ") - 1)
                word, at, spans = 0, 0, []
                for k, a, b, edits in scanner.spans(plain):
                    word, at = word + plain.count(" ", at, a), a
                    n = notices[k]
                    spans.append({"label": n.label, "phrase": n.base, "first": word - 1, "words": plain.count(" ", a, b) + 1, "edits": edits, "likeness": 1 - edits / len(n.words), "text": plain[a:b]})
                rows.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(rows, kind)], names=["doc_id", "n_words", "spans"])

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id bigint, n_words bigint, spans array<{_SPAN}>")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda spans: f"array_join(array_sort(array_distinct(transform({spans}, x -> x.label))), ',')"
    found = find_notices(table(spark, sf_dir, "documents")).withColumn("base", F.expr("filter(spans, x -> x.phrase)"))
    return found.selectExpr(
        "doc_id", "n_words", "cast(size(base) as bigint) as n_base", "array_min(base.first) as first_word", "array_max(base.first) as last_word",
        f"{joined('base')} as base_labels", f"{joined('spans')} as labels", "coalesce(array_max(spans.likeness), 0D) as score",
    )
