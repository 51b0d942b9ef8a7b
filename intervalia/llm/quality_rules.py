"""Operator 1, quality rules: line-first cleaning with DataFrame functions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are removed, and a document that
loses too much of its text, or that fails the base counts, is rejected. One pass, no shuffle, no Python: the work of a
document stays inside its row, so a hot source or a group of copies costs no more than its share.

Edge cases: a null or empty text has no words, so it fails the base rule and is rejected, with an empty clean text.
Repeated rows are judged one by one. Extra columns pass through; new columns replace input columns of the same name.
Windows are compared by their text, not by a hash, so n_repeat_words is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Characters between words.
SPACE = r"[\\x20\\x09-\\x0D]+"
BLANK = r"' \t\n\u000B\u000C\r'"


#: Columns that quality_rules() adds; it replaces input columns of these names.
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "lost_chars", "base_failed", "kept", "clean_text"]


@dataclass(frozen=True)
class LineRules:
    """Limits of the line and document rules. A line is judged only if it has a word."""

    max_symbol_percent: int = 10  # of its characters are # * $ % & | < >
    min_separators: int = 3  # of | > » • between spaces, and
    max_separator_percent: int = 20  # as many for a hundred words
    max_shout_percent: int = 50  # pairs of exclamation marks for a hundred words
    min_unended_words: int = 4  # a line of so many words has to hold a full stop or the like
    boilerplate: tuple[str, ...] = ("all rights reserved", "terms of use", "privacy policy", "cookie policy", "accept cookies", "enable javascript", "lorem ipsum", "click here", "skip to content", "licensed under the")
    max_lost_percent: int = 30  # of the characters of lines with a word


def let(value: str, name: str, body: str) -> str:
    """SQL for body with name bound to value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def words_of(text: str) -> str:
    """Trimmed first, so that split() gives no empty word."""
    trimmed = f"btrim({text}, {BLANK})"
    return f"if({trimmed} = '', cast(array() as array<string>), split({trimmed}, '{SPACE}'))"


def repeat_places(words: str) -> str:
    """Sorted places of windows found twice or more, by sorting the windows' text."""
    windows = f"transform(sequence(1, size({words}) - 2), i -> struct(concat_ws(' ', {words}[i - 1], {words}[i], {words}[i + 1]) as g, cast(i as bigint) as p))"
    return let(f"array_sort({windows})", "s", "array_sort(transform(filter(transform(s, (x, i) -> if(x.g <=> get(s, i - 1).g or x.g <=> get(s, i + 1).g, x.p, 0L)), p -> p > 0L), p -> p))")


def with_repeat_words(docs: DataFrame, words: str = "_words") -> DataFrame:
    """Adds n_repeat_words: words in a 3-word window found twice or more.

    The windows' hashes, with their places in the low 24 bits, are sorted as plain longs; equal neighbours are repeats.
    Where neighbours share the hash bits but not the words, or the text has 2^24 words, the windows' text is sorted
    instead, so that the count is exact.
    """
    packed = f"sort_array(transform(if(size({words}) < 3, cast(array() as array<int>), sequence(1, size({words}) - 2)), i -> (xxhash64({words}[i - 1], {words}[i], {words}[i + 1]) & -16777216L) | i))"
    same = lambda other: f"filter(_packed, (x, i) -> shiftrightunsigned(x ^ get(_packed, {other}), 24) = 0)"
    place = lambda x: f"(({x} & 16777215L))"
    word = lambda x, k: f"{words}[cast({place(x)} as int) + {k - 1}]"
    differ = "exists(zip_with(_later, _earlier, (x, y) -> " + " or ".join(f"{word('x', k)} != {word('y', k)}" for k in range(3)) + "), x -> x)"
    places = f"if(size({words}) >= 16777216 or {differ}, {repeat_places(words)}, array_sort(array_distinct(transform(concat(_later, _earlier), x -> {place('x')}))))"
    count = "aggregate(transform(_places, (p, i) -> if(i = 0, 3L, least(3L, p - _places[i - 1]))), 0L, (a, x) -> a + x)"
    return (
        docs.withColumn("_packed", F.expr(packed))
        .withColumn("_later", F.expr(same("i - 1")))
        .withColumn("_earlier", F.expr(f"if(size(_later) = 0, _later, {same('i + 1')})"))
        .withColumn("_places", F.expr(f"if(size(_later) = 0, _later, {places})"))
        .withColumn("n_repeat_words", F.expr(count))
        .drop("_packed", "_later", "_earlier", "_places")
    )


def occurrences(text: str, of: str) -> str:
    return f"((length({text}) - length(replace({text}, '{of}', ''))) / {len(of)})"


def line_fails(rules: LineRules) -> str:
    """Of l, a line with a word; n_symbols are the line's symbols."""
    n_words = "(length(l) - length(replace(l, ' ', '')) + 1)"
    separators = " + ".join(occurrences("l", f" {c} ") for c in "|>»•")
    phrases = " or ".join(f"contains(low, '{p}')" for p in rules.boilerplate)
    return f"""(
      100 * n_symbols > {rules.max_symbol_percent} * length(l)
      or {separators} >= greatest({rules.min_separators}, {rules.max_separator_percent} * {n_words} / 100)
      or 100 * {occurrences("l", "!!")} > {rules.max_shout_percent} * {n_words}
      or ({n_words} >= {rules.min_unended_words} and not l rlike '[.!?;:…。]')
      or {let("lower(l)", "low", phrases)})"""


def quality_rules(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, line_chars, base_failed, kept and clean_text, which replace columns of these names in any case."""
    t = "coalesce(_text, '')"
    own = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))  # whatever docs' columns are called
    line = f"struct(l as line, btrim(l, {BLANK}) != '' as worded, size(split(l, '[#*$%&|<>]')) - 1 as n_symbols)"
    first = own.withColumns({"_words": F.expr(words_of(t)), "_lines": F.expr(f"transform(split({t}, '\\n'), l -> {line})")})
    fails = let("x.line", "l", let("x.n_symbols", "n_symbols", line_fails(rules)))
    judged = first.withColumn("_lines", F.expr(f"transform(_lines, x -> struct(x.line as line, x.worded as worded, x.n_symbols as n_symbols, x.worded and {fails} as fails))"))
    total = lambda of, where: f"aggregate(transform(filter(_lines, x -> {where}), x -> {of}), 0L, (a, x) -> a + x)"
    counted = with_repeat_words(judged).withColumns(
        {
            "n_words": F.expr("cast(size(_words) as bigint)"),
            "word_chars": F.expr("cast(length(array_join(_words, '')) as bigint)"),
            "n_symbols": F.expr(total("x.n_symbols", "true")),
            "n_dup_lines": F.expr("cast(" + let("transform(filter(_lines, x -> x.worded), x -> x.line)", "d", "size(d) - size(array_distinct(d))") + " as bigint)"),
            "line_chars": F.expr(total("length(x.line)", "x.worded")),
            "lost_chars": F.expr(total("length(x.line)", "x.fails")),
            "clean_text": F.expr("array_join(transform(filter(_lines, x -> not x.fails), x -> x.line), '\n')"),
        }
    )
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    judged = counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.expr(f"100 * lost_chars <= {rules.max_lost_percent} * line_chars"))
    return judged.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in ADDED), *ADDED)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_chars", "lost_chars"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines."""
    row = docs.select(F.struct("*").alias("row"), "text")
    # A row number isn't deterministic, so the filter stays above the projections instead of repeating all their expressions below them.
    judged = quality_rules(row).withColumn("n", F.monotonically_increasing_id()).where("kept and n >= 0")
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("bigint")}
    return judged.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


_R = LineRules()
ORACLE = rf"""
with d as (select doc_id, coalesce(text, '') as t, row_number() over () as r from documents),
w as (select r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x != '') as ws from d),
g as (select r, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] as g from (select r, ws, unnest(range(1, len(ws) - 1)) as p from w)),
rep as (select r, unnest([p, p + 1, p + 2]) as p from (select r, p, count(*) over (partition by r, g) as c from g) where c > 1),
nrep as (select r, count(distinct p) as n_repeat_words from rep group by r),
l as (select r, line, length(line) - length(replace(line, ' ', '')) + 1 as nw, length(line) - length(translate(line, '#*$%&|<>', '')) as sym
      from (select r, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]')),
j as (select r, line, length(line) as n,
        (100 * sym > {_R.max_symbol_percent} * length(line)
         or {" + ".join(f"(length(line) - length(replace(line, ' {c} ', ''))) / 3.0" for c in "|>»•")} >= greatest({_R.min_separators}, {_R.max_separator_percent} * nw / 100.0)
         or 100 * (length(line) - length(replace(line, '!!', ''))) / 2.0 > {_R.max_shout_percent} * nw
         or (nw >= {_R.min_unended_words} and not regexp_matches(line, '[.!?;:…。]'))
         or regexp_matches(lower(line), '{"|".join(_R.boilerplate)}')) as fails from l),
s as (select r, count(*) - count(distinct line) as n_dup_lines, sum(n) as line_chars, coalesce(sum(n) filter (where fails), 0) as lost_chars from j group by r),
c as (select d.doc_id, cast(len(w.ws) as bigint) as n_words,
        cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
        cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols,
        cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
        cast(coalesce(line_chars, 0) as bigint) as line_chars, cast(coalesce(lost_chars, 0) as bigint) as lost_chars
      from d join w using (r) left join nrep using (r) left join s using (r)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and 100 * lost_chars <= {_R.max_lost_percent} * line_chars as kept, line_chars, lost_chars from b
"""
