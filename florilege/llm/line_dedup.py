"""Line dedup through the deletion neighbourhood of lines.

Lines are parts of a text between "\\n", compared as lower-cased (A-Z) words; characters of scripts
that are written without spaces are words of their own. A line goes if an earlier line, by (doc_id,
line number), is equal, or is within one word of it (one word put in, left out or replaced). Two
parameters bound this: lines below `least` words always stay (1: all but blank lines are looked at),
and near copies are sought among lines of `near` words or more (5: one word in five is a similarity
of 0.8). What is earlier is judged on the input.

Equal lines meet by their 128-bit hash. Of the distinct lines, two within one word share either
their first or their last h words, h being half the shorter one's; so only lines that share such a
half with another go on. These emit every variant with one word left out, as a hashed key. Two lines
with one word replaced share the variant at that place, and a line with a word put in has a variant
equal to the other line: so the least position under a key (and place) tells each line of a bucket
whether an earlier one exists, without pairs inside the bucket. Each such find is verified by the
words' edit distance. Joins on keys that many lines share deal those keys over salts. Bit tables of
the halves that are shared, of the texts that hold lines asked for, and of those that lose lines go to
the scans (32 MB each at most), so that only these halves and texts are shuffled; joins then decide.

Defined cases: null text stays null with 0 lines; empty texts have one empty line, which stays; a
row is told by its doc_id and a hash of its text, so rows that share a doc_id lose only lines of
their own, and of these rows neither is earlier at the same line number (equal rows come out equal);
rows without a doc_id are such rows too and come before all others; no rows give no rows; other
columns pass through `drop_lines` as they are, whatever their names, and are not read by
`line_dedup`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import bit_table, may_hold, slices, spread_join, stored

LEAST_WORDS = 1
NEAR_WORDS = 5
NO_ID = -(1 << 63)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)


#: Thai to Lao, Myanmar, Khmer, and the Chinese and Japanese scripts.
SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def words_of(line: bytes) -> list[bytes]:
    if not line.isascii() and SPACELESS.search(text := line.decode()):
        line = SPACELESS.sub(lambda m: f" {m[0]} ", text).encode()
    return line.lower().split()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def halves(words: list[bytes]) -> list[int]:
    """Hashes of the first and last h words for the two sizes that the shorter line of a pair may have."""
    n, found = len(words), set()
    for h in {n // 2, (n - 1) // 2}:
        for side, part in ((b"<", words[:h]), (b">", words[n - h :])):
            found.add(_signed(xxhash.xxh3_64_intdigest(side + b" ".join(part))))
    return sorted(found)


def within_one(a: list, b: list) -> bool:
    """Is the edit distance of two sequences 1 at most?"""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


LINES_DDL = "h1 long, h2 long, doc long, row long, line int, n int, halves array<long>"


def _lines(least: int, near: int):
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))

    def run(batches):
        for b in slices(batches, "text"):
            out = [[] for _ in range(7)]
            for doc, at, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for number, line in enumerate((text or "").encode().split(b"\n")):
                    words = words_of(line)
                    if len(words) < least:
                        continue
                    h = xxhash.xxh3_128_intdigest(b" ".join(words))
                    row = (_signed(h >> 64), _signed(h & (1 << 64) - 1), doc, at, number, len(words), halves(words) if len(words) >= near else None)
                    for o, x in zip(out, row, strict=True):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, types, strict=True)], names=["h1", "h2", "doc", "row", "line", "n", "halves"])

    return run


def _wanted_lines(batches):
    """(h1, h2, doc, line, row, words) of the lines asked for."""
    names, types = ["h1", "h2", "doc", "line", "row", "words"], (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    for b in batches:
        out = []
        for doc, row, text, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
            lines = (text or "").encode().split(b"\n")
            out += [(w["h1"], w["h2"], doc, w["line"], row, b" ".join(words_of(lines[w["line"]]))) for w in wanted]
        cols = zip(*out, strict=True) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def variant_keys(words: list[bytes]) -> np.ndarray:
    """Keys of a line as it is and without each of its words, in order; one pass, however long the line.

    A key is a polynomial over word hashes, so that what follows a word left out only shifts.
    """
    n = len(words)
    with np.errstate(over="ignore"):
        power = np.full(n + 1, BASE, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:n], dtype=np.uint64)])
        without = sums[:-1] + (sums[n] - sums[1:]) * INVERSE
        keys = np.concatenate([sums[n:], without]) + np.array([n] + [n - 1] * n, np.uint64) * MIX
        keys = (keys ^ (keys >> np.uint64(31))) * MIX
    return keys ^ (keys >> np.uint64(29))


def _variants(batches):
    """(key, place, doc, line, row): each line with one word left out at `place`, and whole at place -1."""
    for b in batches:
        keys = [variant_keys(line.split(b" ")) for line in b.column(3).to_pylist()]
        sizes = np.array(list(map(len, keys)), np.int64)
        rep = pa.array(np.repeat(np.arange(b.num_rows), sizes))
        places = np.concatenate([np.arange(-1, n - 1, dtype=np.int32) for n in sizes] or [np.zeros(0, np.int32)])
        keys = np.concatenate(keys or [np.zeros(0, np.uint64)])
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(places), *(b.column(i).take(rep) for i in range(3))], names=["key", "place", "doc", "line", "row"])


def _verified(batches):
    for b in batches:
        near = [within_one(x.split(), y.split()) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield b.select(["h1", "h2"]).filter(pa.array(near, pa.bool_()))


def _before(other, doc, line):
    """Is position `other` earlier than (doc, line)?"""
    return (other["doc"] < doc) | ((other["doc"] == doc) & (other["line"] < line))


def removed_lines(docs: DataFrame, least: int = LEAST_WORDS, near: int = NEAR_WORDS) -> DataFrame:
    """(doc, row, line) of every line of docs(doc, row, text) that an earlier line removes."""
    lines = stored(docs.mapInArrow(_lines(least, near), LINES_DDL))
    at = F.struct("doc", "line", "row")
    distinct = stored(lines.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.first("n").alias("n"), F.first("halves").alias("halves"), F.count(F.lit(1)).alias("rows")))

    half = distinct.where(F.col("n") >= near).select("h1", "h2", "first", F.explode("halves").alias("half"))
    shared = stored(half.groupBy("half").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    half = half.where(may_hold(bit_table(shared.select("half")), "half"))
    wanted = stored(spread_join(half, shared, ["half"], "rows", ["h1"]).groupBy("first.doc", "first.row").agg(F.collect_set(F.struct("h1", "h2", "first.line")).alias("wanted")))
    asked = docs.where(may_hold(bit_table(wanted.select("doc", "row")), "doc", "row"))
    # merged, as beside a broadcast a task would hold two Python workers, the second for the lines
    close = stored(asked.join(wanted.hint("merge"), ["doc", "row"]).select("doc", "row", "text", "wanted").mapInArrow(_wanted_lines, "h1 long, h2 long, doc long, line int, row long, words binary").dropDuplicates(["h1", "h2"]))

    variants = close.select("doc", "line", "row", "words").mapInArrow(_variants, "key long, place int, doc long, line int, row long")
    whole, slot = F.col("place") < 0, F.when(F.col("place") >= 0, at)
    keys = stored(variants.groupBy("key").agg(F.min(F.when(whole, at)).alias("self"), F.min(slot).alias("any_slot"), F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    meeting = stored(spread_join(variants, keys, ["key"], "rows", ["row", "line"]).drop("rows"))
    slots = stored(meeting.where(~whole).groupBy("key", "place").agg(F.min(at).alias("slot"), F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    same_place = spread_join(meeting.where(~whole), slots, ["key", "place"], "rows", ["row", "line"])
    found = None
    for part, other in ((meeting.where(whole), "any_slot"), (meeting.where(~whole), "self"), (same_place, "slot")):
        own = part.where(_before(F.col(other), F.col("doc"), F.col("line"))).select("doc", "line", "row", F.col(other).alias("other"))
        found = own if found is None else found.union(own)
    theirs = close.select(F.struct("doc", "line", "row").alias("other"), F.col("words").alias("o_words"))
    pairs = found.distinct().join(close, ["doc", "line", "row"]).join(theirs, "other")
    near_gone = pairs.select("h1", "h2", "words", "o_words").mapInArrow(_verified, "h1 long, h2 long").distinct().withColumn("near", F.lit(True))

    marks = distinct.join(near_gone, ["h1", "h2"], "left").where("rows > 1 or near").select("h1", "h2", F.col("first.doc").alias("f_doc"), F.col("first.line").alias("f_line"), "near", "rows")
    marked = spread_join(lines.select("h1", "h2", "doc", "row", "line"), stored(marks), ["h1", "h2"], "rows", ["row", "line"])
    return marked.where((F.col("doc") != F.col("f_doc")) | (F.col("line") != F.col("f_line")) | F.col("near")).select("doc", "row", "line")


def drop_lines(docs: DataFrame, counted: bool = False, least: int = LEAST_WORDS, near: int = NEAR_WORDS) -> DataFrame:
    """docs with its text without the removed lines; with `counted`, n_lines and n_removed added."""
    text = F.col("text").cast("string")
    key, told = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(text)
    gone = removed_lines(docs.select(key.alias("doc"), told.alias("row"), text.alias("text")), least, near).groupBy("doc", "row").agg(F.collect_set("line").alias("lines"))
    gone = stored(gone)
    whole = docs.select(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]).alias("whole"), key.alias("doc"), told.alias("row"))
    loses = may_hold(bit_table(gone.select("doc", "row")), "doc", "row")
    parts = F.split("whole.text", "\n", -1)
    number = F.when(F.col("whole.text").isNull(), 0).otherwise(F.size(parts)).cast("long")
    # in expressions, so that no task of this stage has a second Python worker beside the one that looks keys up
    stays = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "lines")
    kept = F.array_join(F.transform(F.array("parts"), lambda p: F.transform(stays, lambda i: F.get(p, i)))[0], "\n")
    changed = whole.where(loses).join(gone, ["doc", "row"], "left").withColumn("parts", F.when(F.col("lines").isNotNull(), parts))
    kept = F.when(F.col("lines").isNull(), F.col("whole.text")).otherwise(kept)
    changed = changed.select("whole", kept.alias("kept"), number.alias("n_lines"), F.coalesce(F.when(F.col("lines").isNotNull(), F.size("lines")), F.lit(0)).cast("long").alias("n_removed"))
    same = whole.where(~loses).select("whole", F.col("whole.text").alias("kept"), number.alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    out = changed.union(same).withColumn("row", F.col("whole").withField("text", F.col("kept")))
    return out.select("row.*", "n_lines", "n_removed") if counted else out.select("row.*")


def line_dedup(docs: DataFrame, least: int = LEAST_WORDS, near: int = NEAR_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, text (what is left) for every row of docs(doc_id, text)."""
    return drop_lines(docs.select("doc_id", F.col("text").cast("string").alias("text")), counted=True, least=least, near=near).select("doc_id", "n_lines", "n_removed", "text")
