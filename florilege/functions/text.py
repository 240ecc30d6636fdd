"""Text functions as Column expressions: tokens, stems, counts, headings, titles, slugs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# English function words and task filler that carry no meaning in a query.
STOPWORDS = frozenset(
    (
        "a about after again all also am an and any are as at be because been before being between both but by can cannot could did do does doing done "
        "down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my "
        "no nor not now of off on once only or other our ours out over own same she should so some such than that the their theirs them then there "
        "these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours "
        "add change code file files fix get help implement make need new please thing update use want work"
    ).split()
)
WORD_CHARS = "A-Za-z0-9À-ɏ"
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿가-힯"
SPACES = r"(?U)\s+"
# a fenced block, closed by a fence of the same sign or open to the end
FENCED = r"(?ms)^[^\S\n]{0,3}(?:```.*?(?:\n[^\S\n]{0,3}```[^\n]*|\z)|~~~.*?(?:\n[^\S\n]{0,3}~~~[^\n]*|\z))"


def let(value: Column, f) -> Column:
    """f(value), the value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def stem(word: Column) -> Column:
    """Plural, then -ing or -ed, then a silent e, then a doubled consonant."""
    return _single(_silent(_verb(_plural(word))))


def _plural(w: Column) -> Column:
    n = F.length(w)
    return (
        F.when(n <= 3, w)
        .when(w.endswith("ies") & (n > 4), F.concat(F.left(w, n - 3), F.lit("y")))
        .when(w.endswith("sses") | (w.rlike("(ch|sh|x|z|s)es$") & (n > 4)), F.left(w, n - 2))
        .when(w.endswith("s") & ~w.rlike("(s|u|i)s$"), F.left(w, n - 1))
        .otherwise(w)
    )


def _verb(w: Column) -> Column:
    return F.regexp_replace(w, "^(.{3,})ing$|^(.{3,})ed$", "$1$2")


def _silent(w: Column) -> Column:
    return F.regexp_replace(w, "^(.{3,})e$", "$1")


def _single(w: Column) -> Column:
    return F.regexp_replace(w, r"^(.{2,})([^aeiou])\2$", "$1$2")


def stems(words: Column) -> Column:
    """Stem of each word of an array; one pass a step, so that expressions stay small."""
    for step in (_plural, _verb, _silent, _single):
        words = F.transform(words, step)
    return words


def raw_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) >= 2)


def tokenize(text: Column) -> Column:
    """Stemmed tokens of two characters or more, in order."""
    return stems(raw_tokens(F.coalesce(text, F.lit(""))))


def query_terms(spark, task: str) -> list[str]:
    """Stemmed, distinct terms of a query string, without stopwords."""
    words = F.filter(raw_tokens(F.lit(task)), lambda w: ~w.isin(*STOPWORDS))
    found = spark.range(1).select(F.array_distinct(F.filter(stems(words), lambda w: F.length(w) >= 2)).alias("t"))
    return list(found.first()["t"])


def runs_about(text: Column, terms: list[str]) -> Column:
    """The stemmed runs of words next to each other, arrays of arrays, that may have one of these stems; all that have one are in them.

    A stem differs from its word at the end only, by one letter and what is cut off, so that a word whose
    stem is a term begins with all but the last letter of it. One expression finds them, and few words are stemmed.
    """
    start = "|".join(sorted({t[:-1] for t in terms}))
    word = f"(?=[a-z0-9]{{2}})(?:{start})[a-z0-9]*+"
    between = "[^a-z0-9]++(?:[a-z0-9][^a-z0-9]++)*+"  # words of one letter are none
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?<![a-z0-9]){word}(?:{between}{word})*+"), F.lit(0))
    return F.transform(found, lambda run: stems(raw_tokens(run)))


def token_count(text: Column) -> Column:
    """The number of tokens of `tokenize`."""
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{2,}+"))


def pairs(words: Column) -> Column:
    """Adjacent pairs of an array's words, joined by a space."""
    return F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, 1 << 30), lambda a, b: F.concat_ws(" ", a, b))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACES), lambda w: w != ""))


def content_hash(text: Column) -> Column:
    return F.sha2(trimmed(F.regexp_replace(text, SPACES, " ")), 256)


def _tenths(text: Column, word_size: int) -> Column:
    """Ten times the tokens of a text without its line ends.

    A run of n signs holds as many pieces of `size` signs at most, one after the other, as n / size rounded up,
    so that counting pieces needs no list of runs; one expression counts those of words and of signs.
    """
    pieces = F.regexp_count(text, F.lit(rf"[{WORD_CHARS}]{{1,{word_size}}}+|[^{WORD_CHARS}{CJK} \t\n\r]{{1,2}}+"))
    return 10 * pieces + 12 * F.regexp_count(text, F.lit(f"[{CJK}]"))


def token_estimate(text: Column) -> Column:
    """Tokens of a text, about: prose words by 6 characters, code by 4, signs by 2, half a token a line end."""
    code = F.regexp_extract_all(text, F.lit(FENCED), F.lit(0))
    fenced = F.array_join(F.transform(code, lambda c: F.regexp_replace(c, r"^\n+", "")), "\n")
    prose = F.regexp_replace(text, FENCED, "\n")
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    # a line end between two segments belongs to neither
    parts = F.split(F.regexp_replace(text, FENCED, "\u0001"), "\u0001")
    # between two blocks a lone line end is no segment, at either end it is one
    bare = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda s: s == "\n")
    around = F.size(F.filter(parts, lambda s: s != "")) - F.size(bare)
    indents = F.aggregate(
        F.regexp_extract_all(fenced, F.lit(r"(?m)^[ \t]+"), F.lit(0)), F.lit(0), lambda n, s: n + F.ceil(F.length(F.replace(s, F.lit("\t"), F.lit("    "))) / F.lit(4)).cast("int")
    )
    plain = _tenths(text, 6) + 5 * ends
    mixed = _tenths(prose, 6) + _tenths(fenced, 4) + 10 * indents + 5 * (ends - (F.size(code) + around - 1))
    tenths = F.when(text.rlike(FENCED), mixed).otherwise(plain)
    return F.when(~text.rlike(r"(?U)\S"), 0).otherwise(F.greatest(F.lit(1), F.floor((tenths + 5) / 10).cast("int")))


def headings(body: Column) -> Column:
    """ATX headings outside fences, as structs (level, text), in order."""
    lines = F.split(body, "\n")
    fence = lambda x: x.rlike(r"^\s{0,3}(```|~~~)")
    # how many fence lines came before decides whether a line is code
    start = F.struct(F.lit(0).alias("fences"), F.array().cast("array<struct<level:int,text:string>>").alias("found"))

    def step(acc, line):
        mark = F.regexp_extract(line, r"^(#{1,6})\s+\S", 1)
        text = F.regexp_replace(F.regexp_replace(line, r"^#{1,6}\s+", ""), r"\s+#+\s*\z", "")
        text = trimmed(text)
        hit = ~fence(line) & (acc["fences"] % 2 == 0) & (mark != "") & (text != "") & ~line.endswith("\r")
        one = F.array(F.struct(F.length(mark).alias("level"), text.alias("text")))
        return F.struct((acc["fences"] + fence(line).cast("int")).alias("fences"), F.when(hit, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    # only lines that matter are folded
    return F.aggregate(F.filter(lines, lambda x: x.rlike(r"^\s{0,3}(#|```|~~~)")), start, step)["found"]


def filename_title(path: Column) -> Column:
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"^(.+)\.[^.]*\z", "$1")
    words = F.filter(F.split(name, r"[-_.\s]+"), lambda w: w != "")
    nice = F.transform(words, lambda w: F.when(w == F.upper(w), w).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))))
    return F.when(F.size(words) == 0, name).otherwise(F.array_join(nice, " "))


def doc_title(path: Column, found: Column) -> Column:
    """First heading of level 1, else the first of any level, else the file's name."""
    first = F.get(F.filter(found, lambda h: h["level"] == 1), F.lit(0))["text"]
    return F.coalesce(first, F.get(found, F.lit(0))["text"], filename_title(path))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def file_slug(name: Column) -> Column:
    """Slug of a file name: without .md, and without a decision record's number."""
    return slugify(F.regexp_replace(F.regexp_replace(F.lower(name), r"\.(md|mdx)$", ""), r"^\d{1,4}[-_]", ""))


def is_slug(text: Column) -> Column:
    return text.rlike(r"^[a-z0-9][a-z0-9-]*\z")


def iso_date(text: Column) -> Column:
    """Is it a date YYYY-MM-DD that exists?"""
    return text.rlike(r"^\d{4}-\d{2}-\d{2}\z") & F.try_to_date(text, "yyyy-MM-dd").isNotNull()


def human_tokens(n: Column) -> Column:
    thousands = F.regexp_replace(F.format_string("%.1f", F.floor(n / 100 + 0.5) / 10), r"\.0$", "")
    return F.when(n < 1000, n.cast("string")).when(n < 100_000, F.concat(thousands, F.lit("k"))).otherwise(F.concat(F.floor(n / 1000 + 0.5).cast("string"), F.lit("k")))


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.when(n == 1, F.lit(one)).otherwise(F.lit(many or f"{one}s"))


def join_sample(items: Column, most: int = 3) -> Column:
    shown = F.array_join(F.slice(items, 1, most), ", ")
    return F.when(F.size(items) <= most, shown).otherwise(F.concat(shown, F.lit(" (+"), (F.size(items) - most).cast("string"), F.lit(" more)")))


def ago(days: Column) -> Column:
    return F.when(days <= 0, F.lit("today")).when(days == 1, F.lit("1 day ago")).otherwise(F.concat(days.cast("string"), F.lit(" days ago")))


def quote_line(text: Column, most: int = 160) -> Column:
    clean = trimmed(F.regexp_replace(text, SPACES, " "))
    return F.when(F.length(clean) > most, F.concat(F.left(clean, F.lit(most - 1)), F.lit("..."))).otherwise(clean)


def snippet(body: Column, query: str, width: int = 220) -> Column:
    """Text around the first place where a word of the query stands."""
    import re

    words = [w for w in re.split("[^a-z0-9_]+", query.lower()) if len(w) > 2]
    low = F.lower(body)
    places = [F.nullif(F.instr(low, w), F.lit(0)) for w in words]
    at = (F.least(*places) if len(places) > 1 else places[0] if places else F.lit(None).cast("int")) - 1
    start = F.coalesce(F.greatest(F.lit(0), at - width // 3), F.lit(0))
    end = F.least(F.length(body), start + width)
    text = trimmed(F.regexp_replace(F.substr(body, start + 1, end - start), SPACES, " "))
    more = F.lit("…")
    return F.concat(F.when(start > 0, more).otherwise(F.lit("")), text, F.when(end < F.length(body), more).otherwise(F.lit("")))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over an ASCII text."""
    return F.aggregate(F.transform(F.split(text, ""), F.ascii), F.lit(2166136261).cast("long"), lambda h, c: h.bitwiseXOR(c.cast("long")) * F.lit(16777619).cast("long") % F.lit(1 << 32))


LEAST_WORDS = 40


def shingle_words(text: Column) -> Column:
    """The words of a text without ``` blocks, of which shingles are made."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"(?s)```.*?```", " "), "[^a-z0-9]+"), lambda w: w != "")


def _runs(words: Column, size: int, make) -> Column:
    """`make` of each run of `size` words; null below LEAST_WORDS."""
    # shifted copies side by side: a slice inside the lambda would read the whole array again for each place
    count = F.greatest(F.size(words) - (size - 1), F.lit(0))
    columns = F.arrays_zip(*[F.slice(words, F.lit(i + 1), count).alias(f"w{i}") for i in range(size)])
    made = F.transform(columns, lambda w: make(*[w[f"w{i}"] for i in range(size)]))
    return F.when(F.size(words) >= LEAST_WORDS, F.array_distinct(made))


def shingles(text: Column, size: int = 5) -> Column:
    """Distinct `size`-word shingles of a text without ``` blocks; null below LEAST_WORDS words."""
    return _runs(shingle_words(text), size, lambda *w: F.concat_ws(" ", *w))


HASHED_AT_ONCE = 1 << 20  # bytes of text; what one pass over them holds stays in a core's cache, about


def _fnv1a_runs(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The distinct 32-bit FNV-1a values, ascending, of the `size`-word runs of each text of words with a space between."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.flatnonzero(joined == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    counts = np.array([t.count(b" ") + 1 for t in texts])
    first = np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(texts)), np.maximum(counts - size + 1, 0))
    at = np.arange(len(of)) - np.repeat(np.cumsum(np.maximum(counts - size + 1, 0)) - np.maximum(counts - size + 1, 0), np.maximum(counts - size + 1, 0)) + first[of]
    length = ends[at + size - 1] - starts[at]
    # the longest first, so that those with another byte are a leading part
    order = np.argsort(-length, kind="stable")
    place, longest = starts[at][order], length[order]
    active = np.searchsorted(-longest, -np.arange(longest[0] if len(longest) else 0), side="left")
    h, prime = np.full(len(order), 2166136261, np.uint32), np.uint32(16777619)
    for i, n in enumerate(active):
        part = h[:n]
        part ^= joined[place[:n] + i]
        part *= prime
    both = np.unique(of[order].astype(np.uint64) << np.uint64(32) | h)
    cut = np.searchsorted(both, np.arange(1, len(texts)).astype(np.uint64) << np.uint64(32))
    return np.split((both & np.uint64(0xFFFFFFFF)).astype(np.int64), cut)


def fnv1a_shingles(text: Column, size: int = 5, least: int | None = None) -> Column:
    """The distinct FNV-1a values of a text's shingles, ascending, only the `least` lowest where given; null below LEAST_WORDS words."""

    def hashed(words: pd.Series) -> pd.Series:
        out: list = [None] * len(words)
        held, room = [], HASHED_AT_ONCE
        for i, w in enumerate(words):
            if w is not None:
                held.append((i, w.encode()))
                room -= len(held[-1][1])
            if held and (room <= 0 or i == len(words) - 1):
                for (k, _), h in zip(held, _fnv1a_runs([t for _, t in held], size), strict=True):
                    out[k] = h[:least]
                held, room = [], HASHED_AT_ONCE
        return pd.Series(out, dtype=object)

    words = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?s)```.*?```", " "), "[^a-z0-9]+", " "))
    enough = F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) >= LEAST_WORDS - 1
    return F.pandas_udf(hashed, "array<bigint>")(F.when(enough, words))
