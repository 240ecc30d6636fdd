"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length.

Folding lower-cases, strips accents, maps look-alike letters and digit substitutions to Latin
letters and everything else to spaces, so patterns may ask for word starts and ends. The lexicon is
learned: words and word beginnings of a bounded sample of labelled training rows, met once or met
twice, are scored by smoothed log-odds, then taken greedily while they explain LEAST_NEW or more
toxic rows not yet explained; a pattern that tells only when met twice counts from its second hit
on. Phrases of a lexicon word and a neighbour that only clean rows use become exceptions and cancel
the hit. A logistic function of the summed weights, in total and by length, gives the score.

Parameters of the model: TRAIN_ROWS bounds the sample, by class, and with it the patterns, the
lexicon and the exceptions, which have no bound of their own; PREFIXES are the lengths of word
beginnings that may become patterns; a pattern needs log-odds of LEAST_ODDS.

Defined cases: null and empty texts score like any text without hits; labels that are null, or of
rows absent from the documents, train nothing; a document labelled twice alike counts once, toxic
and clean once each; of rows that share a doc_id one trains, the one with the least text hash;
without any toxic training label the seed words and default coefficients serve; a null doc_id is
never held out and never trains; no rows give no rows; other columns are not read by `score` and
pass through `keep_clean`.
"""

from __future__ import annotations

import heapq
import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import checkpoint, slices

TRAIN_ROWS = 10_000  # labelled rows of each class that train at most, chosen by a hash of doc_id
LEAST_NEW = 2  # toxic rows that a pattern must newly explain
LEAST_ODDS = 2.5
THRESHOLD = 0.3
PREFIXES = range(4, 8)

# Common insults that serve unless labels say otherwise, and harmless phrases with them.
SEED_WORDS = ("idiot", "moron", "stupid", "scum", "loser", "worthless", "pathetic", "disgusting", "trash", "clown")
SEED_WEIGHT = 4.0
EXCEPTIONS = ("trash can", "trash bin", "sore loser rule", "circus clown")
# Letters of other scripts that look Latin, and digits or signs that stand for letters.
LOOKALIKES = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


class _Fold(dict):
    """str.translate table, filled on demand: one character to letters, a space or nothing."""

    def __missing__(self, code: int) -> str:
        char = chr(code).lower()
        if char in LOOKALIKES or char in DIGITS:
            out = LOOKALIKES.get(char) or DIGITS[char]
        else:
            parts = unicodedata.normalize("NFKD", char)
            out = "".join(LOOKALIKES.get(p, p) for p in parts.lower() if not unicodedata.combining(p))
            out = "".join(p if p.isalnum() else "" if unicodedata.category(p) in ("Cf", "Mn") else " " for p in out)
        self[code] = out
        return out


FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded words between single spaces, with one at either end."""
    return f" {' '.join((text or '').translate(FOLD).split())} "


@dataclass
class Model:
    """weights: pattern -> (weight, hits from which it counts). exceptions: phrase -> pattern that it cancels."""

    weights: dict[str, tuple[float, int]] = field(default_factory=lambda: {f" {w} ": (SEED_WEIGHT, 1) for w in SEED_WORDS})
    exceptions: dict[str, str] = field(default_factory=dict)
    coefficients: tuple[float, float, float] = (-3.0, 1.2, 0.4)

    def automaton(self) -> ahocorasick.Automaton:
        """Its values are (pattern, +1 or -1)."""
        a = ahocorasick.Automaton()
        for phrase, pattern in self.exceptions.items():
            a.add_word(phrase, (pattern, -1))
        for pattern in self.weights:
            a.add_word(pattern, (pattern, 1))
        if len(a):
            a.make_automaton()
        return a

    def features(self, text: str | None, a: ahocorasick.Automaton) -> tuple[float, float]:
        """log(1 + weight of all hits), log(1 + that weight by 100 words)."""
        folded, hits = fold(text), Counter()
        for _, (pattern, n) in a.iter(folded) if len(a) else ():
            hits[pattern] += n
        total = sum(w * max(0, n - k + 1) for p, n in hits.items() for w, k in [self.weights[p]])
        return math.log1p(total), math.log1p(100 * total / (folded.count(" ") + 20))

    def score(self, text: str | None, a: ahocorasick.Automaton) -> float:
        x, y = self.features(text, a)
        c, u, v = self.coefficients
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, c + u * x + v * y))))


def patterns(text: str | None) -> set[tuple[str, int]]:
    """Words (' word ') and word beginnings (' wor') of a text, folded, each with 1 and, if met again, 2."""
    found = Counter()
    for w, n in Counter(fold(text).split()).items():
        if len(w) > 2:
            found[f" {w} "] += n
        for m in PREFIXES:
            if len(w) > m:
                found[f" {w[:m]}"] += n
    return {(p, 1) for p in found} | {(p, 2) for p, n in found.items() if n > 1}


def _counted(batches):
    """(pattern, toxic rows, clean rows), summed over each slice."""
    for b in slices(batches, "text", 16 << 20):
        counts: dict[tuple[str, int], list[int]] = {}
        for text, toxic in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            for p in patterns(text):
                counts.setdefault(p, [0, 0])[0 if toxic else 1] += 1
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in counts], pa.string()), pa.array([k for _, k in counts], pa.int32()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["p", "k", "t", "c"])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the sample, a row for each id and class; the ids are a broadcast of 2 * TRAIN_ROWS rows at most."""
    usable = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("id")))
    some = [usable.where(F.col("toxic") == t).distinct().orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS) for t in (0, 1)]
    ids = checkpoint(some[0].union(some[1]))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id"))
    return rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "toxic")


def _greedy(odds: dict[tuple[str, int], float], toxic_sets: list[list[tuple[str, int]]]) -> list[tuple[str, int]]:
    """Patterns in order of the toxic rows they newly explain times their odds, the longer first among equals.

    Gains only shrink as rows are explained, so a pattern is measured anew only when it comes first.
    """
    holders: dict[tuple[str, int], set[int]] = {p: set() for p in odds}
    for i, row in enumerate(toxic_sets):
        for p in row:
            holders[p].add(i)
    turn = {p: -i for i, p in enumerate(sorted(odds, key=lambda p: (len(p[0]), p)))}
    heap = [(-len(rows) * odds[p], turn[p], p) for p, rows in holders.items() if len(rows) >= LEAST_NEW]
    heapq.heapify(heap)
    chosen, open_rows = [], set(range(len(toxic_sets)))
    while heap:
        best = heapq.heappop(heap)[2]
        new = holders[best] & open_rows
        key = (-len(new) * odds[best], turn[best], best)
        if len(new) < LEAST_NEW:
            continue
        if heap and key > heap[0]:
            heapq.heappush(heap, key)
            continue
        chosen.append(best)
        open_rows -= new
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> tuple[float, float, float]:
    """Ridge logistic coefficients (constant first) by Newton steps; slopes stay at 0 or more."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(3), np.diag([1e-6, ridge, ridge]) * len(x) ** 0.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(0.0, w[1])), float(max(0.0, w[2]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = checkpoint(training_rows(docs, labels))
    totals = {bool(r.toxic): r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not totals.get(True) or not totals.get(False):
        return Model()
    toxic, clean = totals[True], totals[False]
    counts = checkpoint(rows.mapInArrow(_counted, "p string, k int, t long, c long").groupBy("p", "k").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where("t > 1 or c > 1"))
    odds_of = F.log((F.col("t") + 0.25) / F.lit(toxic + 0.5)) - F.log((F.col("c") + 0.25) / F.lit(clean + 0.5))
    least = min(3, max(2, toxic // 40))
    telling = counts.withColumn("odds", odds_of).where((F.col("t") >= least) & (F.col("odds") >= LEAST_ODDS))
    odds = {(r.p, r.k): r.odds for r in telling.toLocalIterator()}  # bounded by the sample

    listed = sorted(odds)
    order = {p: i for i, p in enumerate(listed)}

    def present(batches):
        known = frozenset(order)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([[order[p] for p in patterns(t) & known] for t in b.column(0).to_pylist()], pa.list_(pa.int32()))], names=["ps"])

    sets = [[listed[i] for i in r.ps] for r in rows.where("toxic = 1").orderBy("doc_id").select("text").mapInArrow(present, "ps array<int>").toLocalIterator()]
    chosen = _greedy(odds, sets)
    denied = {r.p for r in counts.where(F.col("k") == 1).where(F.col("p").isin([f" {w} " for w in SEED_WORDS])).where((odds_of < LEAST_ODDS) & (F.col("c") > 1)).collect()}
    seeds = {p: w for p, w in Model().weights.items() if p not in denied}
    model = Model(weights=seeds | {p: (round(odds[p, k], 4), k) for p, k in chosen})
    model.exceptions = _exceptions(rows, model)
    auto = model.weights, model.exceptions

    def measured(batches):
        m = Model(*auto)
        a = m.automaton()
        for b in batches:
            found = [m.features(t, a) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), b.column(1).cast(pa.int32())], names=["x", "y", "toxic"])

    seen = rows.select("text", "toxic").mapInArrow(measured, "x double, y double, toxic int").collect()  # bounded by the sample
    seen = np.array(sorted((r.toxic, r.x, r.y) for r in seen), float)
    model.coefficients = _logistic(seen[:, 1:], seen[:, 0])
    return model


def _exceptions(rows: DataFrame, model: Model) -> dict[str, str]:
    """Phrases of a hit and one neighbour that two clean rows or more and no toxic row use."""
    weights = model.weights

    def around(batches):
        a = Model(weights).automaton()
        for b in batches:
            found = []
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                folded, own = fold(text), set()
                for end, _ in a.iter(folded):
                    start = folded.rfind(" ", 0, end - 1 if folded[end] == " " else end)
                    stop = folded.find(" ", end)
                    stop = len(folded) - 1 if stop < 0 else stop
                    own.add(folded[folded.rfind(" ", 0, max(start, 1)) if start > 0 else 0 : stop + 1])
                    after = folded.find(" ", stop + 1)
                    own.add(folded[start : (after if after > 0 else len(folded) - 1) + 1])
                found += [(p, 1 - toxic, toxic) for p in own if p.count(" ") > 2]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32())], names=["p", "c", "t"])

    clean = rows.select("text", "toxic").mapInArrow(around, "p string, c int, t int").groupBy("p").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).where("c >= 2 and t = 0")
    found = sorted(r.p for r in clean.collect()) + [f" {p} " for p in EXCEPTIONS]  # bounded by the sample
    a = Model(weights).automaton()
    return {p: hits[0] for p in found if (hits := [x for _, (x, _) in a.iter(p)])}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text)."""

    def run(batches):
        a = model.automaton()
        for b in slices(batches, "text", 16 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t, a) for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not rejected, whatever their columns."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        a = model.automaton()
        for b in slices(batches, "text"):
            yield b.filter(pa.array([model.score(t, a) < THRESHOLD for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
