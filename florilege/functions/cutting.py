"""Texts cut down to a number of tokens, as Column expressions: whole blocks, else sentences, else characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from florilege.functions import text as T

ATTEMPTS = 9  # the first cut and eight smaller ones
FENCE_LINE = r"[^\S\n]{0,3}(?:```|~~~)"
# lines end at \n alone; a paragraph goes on up to a blank line, a heading or a fence
BLOCK = rf"(?dU)(?:{T.FENCED})|(?m)^(?!{FENCE_LINE})(?=[^\n]*\S)[^\n]*+(?:\n(?!{FENCE_LINE}|#{{1,6}}\s)(?=[^\n]*\S)[^\n]*+)*+"


def blocks(text: Column) -> Column:
    """Paragraphs, headings with what follows, and whole fenced blocks; a text without any is its own block."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0)), T.trimmed), lambda b: b != "")
    return T.let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(text)))


def fence_closed(text: Column) -> Column:
    """The text, with an end for a fenced block that has none."""
    fenced = F.regexp_extract_all(text, F.lit(f"(?d){T.FENCED}"), F.lit(0))

    def close(found):
        last = F.coalesce(F.get(found, F.size(found) - 1), F.lit(""))
        open_by = lambda sign: last.rlike(rf"^\s*{sign}") & ~last.rlike(rf"\n[^\S\n]{{0,3}}{sign}{{3}}[^\n]*\z")
        return F.when(open_by("`"), F.concat(text, F.lit("\n```"))).when(open_by("~"), F.concat(text, F.lit("\n~~~"))).otherwise(text)

    return T.let(fenced, close)


def _leading(costs: Column, budget: Column) -> Column:
    """How many of the first costs sum up to the budget at most; they stop at the first that does not fit."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"))
    # a cost that is over the budget leaves a sum that nothing fits any more
    step = lambda a, c: F.struct((a["sum"] + c).alias("sum"), (a["n"] + (a["sum"] + c <= budget).cast("int")).alias("n"))
    return F.aggregate(costs, start, step)["n"]


def _cut(text: Column, whole: Column, parts: Column, costs: Column, budget: Column) -> Column:
    def joined(pieces, n, by):
        return fence_closed(F.rtrim(F.array_join(F.slice(pieces, F.lit(1), n), by), F.lit(" \t\n\r\f\u000b")))

    def smaller(first):
        sentences = F.split(first, r"(?U)(?<=[.!?])\s+")
        density = F.length(text) / F.greatest(F.lit(1), whole)
        some = fence_closed(F.rtrim(F.left(text, F.greatest(F.lit(1), F.floor(budget * density).cast("int"))), F.lit(" \t\n\r\f\u000b")))
        return T.let(sentences, lambda s: T.let(_leading(F.transform(s, T.token_estimate), budget), lambda n: F.when(n > 0, joined(s, n, " ")).otherwise(some)))

    kept = T.let(_leading(costs, budget), lambda n: F.when(n > 0, joined(parts, n, "\n\n")).otherwise(smaller(F.get(parts, F.lit(0)))))
    return F.when(budget <= 0, F.lit("")).when(whole <= budget, text).otherwise(kept)


def truncated(text: Column, budget: Column) -> Column:
    """The first blocks whose costs sum up to the budget at most; else the first sentences of the first block;
    else as many characters as the text's own density gives. The result may cost a little more than the budget."""
    costs = lambda parts: F.transform(parts, T.token_estimate)
    cut = lambda whole, parts: T.let(costs(parts), lambda c: _cut(text, whole, parts, c, budget))
    return T.let(T.token_estimate(text), lambda whole: T.let(blocks(text), lambda parts: cut(whole, parts)))


def fitted(text: Column, budget: Column) -> Column:
    """struct(text, tokens): `truncated` to targets smaller by a tenth each time until the result costs the budget
    at most; a null text where eight smaller targets do not help.

    Blocks and their costs are worked out once. A null text or budget gives null.
    """

    def search(whole, parts, costs):
        none = F.lit(None).cast("string")
        start = F.struct(budget.cast("long").alias("target"), none.alias("text"), F.lit(None).cast("int").alias("tokens"))

        def step(a, _):
            def tried(out):
                cost = T.token_estimate(out)
                made = lambda n: F.struct(F.floor(a["target"] * 9 / 10).alias("target"), F.when(n <= budget, out).alias("text"), F.when(n <= budget, n).alias("tokens"))
                return T.let(cost, made)

            return F.when(a["text"].isNotNull() | (a["target"] < 1), a).otherwise(T.let(_cut(text, whole, parts, costs, a["target"]), tried))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(ATTEMPTS)), start, step, lambda a: F.struct(a["text"].alias("text"), a["tokens"].alias("tokens")))
        empty = F.struct(F.lit("").alias("text"), F.lit(0).alias("tokens"))
        return F.when(budget <= 0, empty).otherwise(found)

    made = T.let(T.token_estimate(text), lambda w: T.let(blocks(text), lambda p: T.let(F.transform(p, T.token_estimate), lambda c: search(w, p, c))))
    return F.when(text.isNotNull() & budget.isNotNull(), made)
