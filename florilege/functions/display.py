"""Texts in columns of a terminal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of two columns, and those of none.
WIDE = "ᄀ-ᅟ〈〉⺀-〾぀-꓏가-힣豈-﫿︰-﹯＀-｠￠-￦\\x{1f300}-\\x{1f64f}\\x{1f900}-\\x{1f9ff}\\x{20000}-\\x{3fffd}"
NONE = "‍︀-️\\x00-\\x1f\\x7f-\\x9f"
COLOUR = "\u001b\\[[0-9;]*m"
MORE = "…"


def plain(text: Column) -> Column:
    return F.regexp_replace(text, COLOUR, "")


def width(text: Column) -> Column:
    """Columns that a text takes: two for wide characters, none for colours, joiners and control characters."""
    shown = F.regexp_replace(plain(text), f"[{NONE}]", "")
    return F.length(shown) * 2 - F.length(F.regexp_replace(shown, f"[{WIDE}]", ""))


def pad(text: Column, to: int, left: bool = False) -> Column:
    blank = F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(to) - width(text)))
    return F.concat(blank, text) if left else F.concat(text, blank)


def truncate(text: Column, most: int) -> Column:
    """A text cut on the right to `most` columns, with a sign that it is cut."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("w"), F.lit(True).alias("on"))

    def step(acc, c):
        w = acc["w"] + width(c)
        on = acc["on"] & (w <= most - 1)
        return F.struct(F.when(on, F.concat(acc["s"], c)).otherwise(acc["s"]).alias("s"), F.when(on, w).otherwise(acc["w"]).alias("w"), on.alias("on"))

    # no character is narrower than half a column, but for those of none
    cut = F.aggregate(F.split(F.left(plain(text), F.lit(4 * max(1, most))), ""), start, step)["s"]
    return F.when(F.lit(most <= 0), "").when(width(text) <= most, text).otherwise(F.concat(cut, F.lit(MORE)))


def truncate_path(path: Column, most: int) -> Column:
    """A path cut on the left, at a folder's start where its name fits."""
    keep = max(1, most - 2)
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    fits = F.filter(tails, lambda t: width(t) <= keep)
    inside = F.concat(F.lit(MORE), F.right(name, F.lit(max(1, most - 1))))
    return F.when(F.lit(most <= 0), "").when(width(path) <= most, path).when(width(name) > keep, inside).otherwise(F.concat(F.lit(f"{MORE}/"), F.get(fits, F.lit(0))))


def wrap(text: Column, to: int) -> Column:
    """Lines of at most `to` columns, broken at white space; longer words are cut into pieces of `to` characters."""
    room = max(4, to)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    pieces = F.flatten(F.transform(words, lambda w: F.when(width(w) <= room, F.array(w)).otherwise(F.regexp_extract_all(w, F.lit(f"(?s).{{1,{room}}}"), F.lit(0)))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def step(acc, w):
        longer = F.when(acc["line"] == "", w).otherwise(F.concat(acc["line"], F.lit(" "), w))
        full = (width(longer) > room) & (acc["line"] != "")
        return F.struct(F.when(full, F.array_append(acc["done"], acc["line"])).otherwise(acc["done"]).alias("done"), F.when(full, w).otherwise(longer).alias("line"))

    out = F.aggregate(pieces, start, step)
    return F.when(out["line"] == "", out["done"]).otherwise(F.array_append(out["done"], out["line"]))
