"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters of all scripts, folded to ALPHABET classes (letters without accents,
one class for capitals, one for digits, one for white space, the rest by code point; code points
from FOLDED on share classes by a remainder), with ORDER-grams. Trusted rows are the labelled rows
of quality 1, all of them: one in HELD, by a hash of the text, sets the thresholds, the others train
the model, so that thresholds hold for text the model has not seen. Counts, continuation counts, discounts and interpolated probabilities are
DataFrame aggregates and joins sharded by gram; the tables grow with the trusted text.

Documents meet the model by their distinct grams. A model of at most TABLE_ROWS rows, which is
counted first, goes to the scorers as a broadcast and is looked up for each batch's distinct grams.
A larger one stays sharded: the corpus's distinct grams are joined with it order by order, then the
documents' gram counts with the resulting probabilities, large grams over salts. Both ways give the
same perplexities. A document is kept where its perplexity, drawn towards its language's mean by
PRIOR characters, is at most the QUANTILE of its language's held-back trusted rows, times MARGIN.

Defined cases: null and empty texts have the language's mean perplexity and are kept; texts of any
length are read whole, in pieces; a null lang is a language of its own; a language with fewer than
LEAST_TRUSTED held-back rows uses the quantile of all languages; without any every document is kept,
and without trained rows at perplexity ALPHABET; labels that are null or of absent rows train nothing; repeated rows
are scored each and train each; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import math
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import checkpoint, slices, spread_join, stored

BITS = 12
ALPHABET = 1 << BITS
ORDER = 5
QUANTILE = 0.998
MARGIN = 1.05
HELD = 5
PRIOR = 30
LEAST_TRUSTED = 6  # held-back rows, of about 30 trusted ones
TABLE_ROWS = 4_000_000  # a model of 64 MB; larger ones are joined
FOLDED = 3072
SHARED = 1021  # classes of the code points from FOLDED on
PIECE = 1 << 20  # characters that are looked up at once


@cache
def _classes() -> np.ndarray:
    """Class of each code point of the Basic Multilingual Plane."""
    out = np.zeros(1 << 16, np.int64)
    for i in range(1 << 16):
        char = chr(i)
        if char in " \t\n\r\x0b\x0c":
            out[i] = ord(" ")
        elif char.isupper():
            out[i] = ord("A")
        elif char.isdigit():
            out[i] = ord("0")
        else:
            base = ord(unicodedata.normalize("NFD", char)[0]) if i < 0x3000 else i
            out[i] = base if base < FOLDED else FOLDED + base % SHARED
    return out


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(points < 1 << 16, _classes()[np.minimum(points, (1 << 16) - 1)], FOLDED + points % SHARED)


def grams(texts: list[str | None]):
    """(row, code) of the ORDER-grams that end at each character, a text starting after spaces, about PIECE at once."""
    rows, parts, total = [], [], 0

    def out():
        own = classes("".join(parts))
        sizes = np.array([len(p) - ORDER + 1 for p in parts], np.int64)
        codes = np.zeros(max(0, len(own) - ORDER + 1), np.int64)
        for k in range(ORDER):
            codes = codes << BITS | own[k : len(own) - ORDER + 1 + k]
        starts = np.cumsum(sizes + ORDER - 1) - (sizes + ORDER - 1)
        at = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.repeat(rows, sizes), codes[at]

    for i, text in enumerate(texts):
        for start in range(0, len(text or ""), PIECE):
            lead = text[start - ORDER + 1 : start] if start else " " * (ORDER - 1)
            rows.append(i)
            parts.append(lead + text[start : start + PIECE])
            total += len(parts[-1])
            if total >= PIECE:
                yield out()
                rows, parts, total = [], [], 0
    if parts:
        yield out()


def _counted(batches):
    for b in slices(batches, "text"):
        for _, codes in grams(b.column(0).to_pylist()):
            code, n = np.unique(codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["gram", "n"])


def _last(gram, order: int):
    """The last `order` characters of a gram."""
    return gram.bitwiseAND(F.lit((1 << BITS * order) - 1))


def counts(trusted: DataFrame) -> DataFrame:
    """(order, gram, n): ORDER-gram counts, and below them continuation counts."""
    own = stored(trusted.select("text").mapInArrow(_counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    found = own.select(F.lit(ORDER).alias("order"), "gram", "n")
    for order in range(ORDER - 1, 0, -1):
        own = own.groupBy(_last(F.col("gram"), order).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        found = found.union(own.select(F.lit(order).alias("order"), "gram", "n"))
    return stored(found)


def _discounts(seen: DataFrame) -> dict[int, tuple[float, float, float]]:
    """Modified Kneser-Ney discounts of each order from the counts of counts."""
    rows = seen.where("n <= 4").groupBy("order", "n").count().collect()  # at most 4 * ORDER rows
    of = {(r["order"], r["n"]): r["count"] for r in rows}
    out = {}
    for order in range(1, ORDER + 1):
        n = [of.get((order, i), 0) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        out[order] = tuple(min(i, max(0.0, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] else 0.5 * i for i in (1, 2, 3))
    return out


def model(seen: DataFrame) -> DataFrame:
    """(order, context, key, value): log p of every gram that was seen, and by context the log weight of the lower order."""
    discounts, tables, lower = _discounts(seen), [], None
    for order in range(1, ORDER + 1):
        d = discounts[order]
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        own = seen.where(F.col("order") == order).select("gram", "n", F.shiftright("gram", BITS).alias("before"), cut.alias("cut"))
        contexts = own.groupBy("before").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("weight"))
        below = F.lit(1.0 / ALPHABET)
        joined = own.join(contexts, "before")
        if lower is not None:
            joined = joined.join(lower, _last(F.col("gram"), order - 1) == F.col("suffix"))
            below = F.col("q")
        found = checkpoint(joined.select("gram", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("weight") * below).alias("p")))
        lower = found.select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
        log = lambda x: F.log(F.greatest(x, F.lit(1e-12)))
        row = lambda is_context, key, value: (F.lit(order).alias("order"), F.lit(is_context).alias("context"), key.alias("key"), log(value).alias("value"))  # noqa: E731, B023
        tables += [found.select(*row(False, F.col("gram"), F.col("p"))), contexts.select(*row(True, F.col("before"), F.col("weight")))]
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return stored(out)


class Tables:
    """The model as sorted arrays."""

    def __init__(self, rows: pa.Table) -> None:
        order, context, key, value = (rows[c].to_numpy() for c in ("order", "context", "key", "value"))
        self.of = {}
        for n in range(1, ORDER + 1):
            for c in (False, True):
                own = (order == n) & (context == c)
                at = np.argsort(key[own])
                self.of[n, c] = key[own][at], value[own][at]

    def _find(self, n: int, context: bool, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = self.of[n, context]
        if not len(keys):
            return np.zeros(len(codes), bool), np.zeros(len(codes))
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        return keys[at] == codes, values[at]

    def log_p(self, codes: np.ndarray) -> np.ndarray:
        """Of ORDER-grams: what was not seen backs off through its contexts."""
        out, live = np.zeros(len(codes)), np.arange(len(codes))
        for n in range(ORDER, 0, -1):
            hit, value = self._find(n, False, codes)
            out[live[hit]] += value[hit]
            live, codes = live[~hit], codes[~hit]
            known, weight = self._find(n, True, codes >> BITS)
            out[live[known]] += weight[known]
            codes = codes & ((1 << BITS * (n - 1)) - 1)
        out[live] -= math.log(ALPHABET)
        return out


def _looked_up(own: DataFrame, rows: pa.Table) -> DataFrame:
    """own(doc_id, lang, held, text) as (doc_id, lang, held, n_chars, bits), by a broadcast of the model."""
    shared = own.sparkSession.sparkContext.broadcast(Tables(rows))

    def run(batches):
        tables = shared.value
        for b in slices(batches, "text"):
            texts = b.column(3).to_pylist()
            bits = np.zeros(b.num_rows)
            for row, codes in grams(texts):
                code, at = np.unique(codes, return_inverse=True)
                bits -= np.bincount(row, weights=tables.log_p(code)[at], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([len(t or "") for t in texts], pa.int64()), pa.array(bits)], names=["doc_id", "lang", "held", "n_chars", "bits"])

    return own.mapInArrow(run, "doc_id long, lang string, held boolean, n_chars long, bits double")


def _text_grams(batches):
    for b in slices(batches, "text"):
        texts = b.column(0).to_numpy(zero_copy_only=False)
        for row, codes in grams(b.column(1).to_pylist()):
            order = np.lexsort((codes, row))
            row, codes = row[order], codes[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (codes[1:] != codes[:-1])]))
            yield pa.RecordBatch.from_arrays([pa.array(texts[row[first]]), pa.array(codes[first]), pa.array(np.diff(np.append(first, len(codes))))], names=["told", "gram", "n"])


def _joined(own: DataFrame, rows: DataFrame) -> DataFrame:
    """own(doc_id, lang, held, text) as (doc_id, lang, held, n_chars, bits), by joins of grams with the sharded model."""
    own = own.withColumn("told", F.xxhash64("text"))
    narrow = checkpoint(own.select("doc_id", "lang", "held", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "told"))
    held = stored(own.select("told", "text").mapInArrow(_text_grams, "told long, gram long, n long").groupBy("told", "gram").agg(F.sum("n").alias("n")))
    distinct = stored(held.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")))
    open_, done = distinct.select("gram", "rows", F.col("gram").alias("code"), F.lit(0.0).alias("sum")), None
    part = lambda n, context: rows.where((F.col("order") == n) & (F.col("context") == context)).select("key", "value")
    for n in range(ORDER, 0, -1):
        met = open_.join(part(n, False), F.col("code") == F.col("key"), "left").drop("key")
        hit = met.where("value is not null").select("gram", "rows", (F.col("sum") + F.col("value")).alias("sum"))
        missed = met.where("value is null").drop("value").join(part(n, True), F.shiftright("code", BITS) == F.col("key"), "left")
        open_ = checkpoint(missed.select("gram", "rows", _last(F.col("code"), n - 1).alias("code"), (F.col("sum") + F.coalesce("value", F.lit(0.0))).alias("sum")))
        done = hit if done is None else done.union(hit)
    done = stored(done.union(open_.select("gram", "rows", (F.col("sum") - math.log(ALPHABET)).alias("sum"))))
    # equal texts put their grams in `held` once each
    copies = narrow.groupBy("told").agg(F.count(F.lit(1)).alias("copies"))
    bits = spread_join(held, done, ["gram"], "rows", ["told"]).groupBy("told").agg((-F.sum(F.col("n") * F.col("sum"))).alias("bits"))
    bits = stored(copies.join(bits, "told", "left").select("told", "copies", (F.coalesce("bits", F.lit(0.0)) / F.col("copies")).alias("bits")))
    return spread_join(narrow, bits, ["told"], "copies", ["doc_id"]).select("doc_id", "lang", "held", "n_chars", "bits")


def trusted_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs with a label of quality 1; a merge join at every size, as labels grow with the corpus."""
    ids = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("id")).distinct()
    return docs.join(ids.hint("merge"), docs.doc_id == ids.id, "left_semi")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, kept for every row of docs(doc_id, lang, text)."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    own = own.select("doc_id", "lang", (F.pmod(F.xxhash64("text"), F.lit(HELD)) == 0).alias("held"), "text")
    rows = model(counts(trusted_rows(own.where("not held").select("doc_id", "text"), labels)))
    scored = checkpoint(_looked_up(own, rows.toArrow()) if rows.count() <= TABLE_ROWS else _joined(own, rows))
    marked = checkpoint(trusted_rows(scored.where("held"), labels))
    mean = F.sum("bits") / F.greatest(F.sum("n_chars"), F.lit(1))
    overall = marked.agg(F.sum("bits"), F.sum("n_chars")).first()
    overall = overall[0] / overall[1] if overall[1] else math.log(ALPHABET)
    means = marked.groupBy("lang").agg(mean.alias("mean"), F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= LEAST_TRUSTED).select(F.col("lang").alias("of"), "mean")
    drawn = F.exp((F.col("bits") + PRIOR * F.coalesce("mean", F.lit(overall))) / (F.col("n_chars") + PRIOR))
    shrunk = lambda df: df.join(means, F.col("lang").eqNullSafe(F.col("of")), "left").withColumn("perplexity", drawn).drop("of")
    marked, scored = shrunk(marked), shrunk(scored)
    cut = lambda df: df.agg(F.percentile_approx("perplexity", QUANTILE, 10_000).alias("threshold"), F.count(F.lit(1)).alias("rows"))
    every = cut(marked).first()["threshold"]
    limits = cut(marked.groupBy("lang")).where(F.col("rows") >= LEAST_TRUSTED).select(F.col("lang").alias("of"), "threshold")
    judged = scored.join(limits, F.col("lang").eqNullSafe(F.col("of")), "left")
    threshold = MARGIN * F.coalesce("threshold", F.lit(every).cast("double"), F.lit(float("inf")))
    return judged.select("doc_id", "lang", "n_chars", "perplexity", threshold.alias("threshold"), (F.col("perplexity") <= threshold).alias("kept"))
