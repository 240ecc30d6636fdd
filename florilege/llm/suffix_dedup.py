"""Repeated 100-byte strings: a depth-limited radix sort of suffixes over all documents.

Only the first DEPTH bytes of a suffix matter, so suffixes are ordered by most-significant-digit
passes and a group of one leaves after each pass; groups that are equal through DEPTH are exactly
the repeated windows. The first two digits are anchored in the content, so that whole runs of
suffixes move as one row: the window of DEPTH bytes at a suffix has an anchor, its least GRAM-byte
gram, and neighbouring windows with the same anchor form one run.

Pass 1 deals runs by the hash of their anchor gram: equal windows have equal anchors.
Pass 2 splits by a hash of the whole run's bytes: in equal runs all windows are equal, so every run
but the first is covered. Most groups end here. The two hashes are of different kinds (a mixed
polynomial and XXH3), 128 bits together.
Pass 3 orders the single windows of what is left by their bytes, eight at a time from the first on,
until groups are single or equal through DEPTH; nothing there rests on a hash.

Copies within one slice of input are settled on the map side, so that a frequent run sends one row a
slice. Positions are (doc_id, byte offset); a byte is removed if a window over it also starts
earlier, that is in a row of a smaller doc_id, or in a row of the same doc_id at a smaller offset.
Spans belong to a row, which is told by its doc_id and a hash of its text.

Defined cases: null text counts as empty; texts below DEPTH bytes keep everything; rows that share a
doc_id are rows of their own, of which neither is earlier at the same offset, so equal rows keep
what no other row has and their results are equal; rows without a doc_id are such rows too and come
before all others; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import buffers, slices, stored

DEPTH = 100
GRAM = 40
SLICE = 2 << 20
HOT_RUNS = 20_000  # a group with more runs goes on window by window, dealt by the window's hash
NO_ID = -(1 << 63)
BASE = 0x9E3779B97F4A7C15
U = np.uint64


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random odd value for each byte; powers of the base and of its inverse modulo 2**64."""
    values = np.random.default_rng(2718).integers(0, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
    powers = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(SLICE + DEPTH + 1, U(base))
        p[0] = 1
        powers.append(np.multiply.accumulate(p))
    return values, *powers


def _mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _prefix(data: np.ndarray) -> np.ndarray:
    values, powers, _ = _tables()
    return np.concatenate([np.zeros(1, U), np.cumsum(values[data] * powers[: len(data)], dtype=U)])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the first least value in each window of h."""
    at, span = np.arange(len(h), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        left, right = h[:-step], h[step:]
        less = right < left
        at, h = np.where(less, at[step:], at[:-step]), np.where(less, right, left)
        span += step
    return at


def runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, run hash, row, start in row, windows - 1) of the texts in a buffer."""
    empty = np.zeros(0, np.int64)
    if len(data) < DEPTH:
        return empty.astype(U), empty.astype(U), empty, empty, empty
    h = _prefix(data)
    n = len(data)
    grams = _mix((h[GRAM:] - h[:-GRAM]) * _tables()[2][: n - GRAM + 1])
    anchor = _least(grams, DEPTH - GRAM + 1)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    whole = row[: n - DEPTH + 1] == row[DEPTH - 1 :]
    row = row[: n - DEPTH + 1]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]) | (row[1:] != row[:-1])])
    lo = np.flatnonzero(new)
    hi = np.concatenate([lo[1:], [len(new)]]) - 1
    lo, hi = lo[whole[lo]], hi[whole[lo]]
    raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    whole_run = np.fromiter([digest(raw[x:y]) for x, y in zip(lo.tolist(), (hi + DEPTH).tolist(), strict=True)], U, len(lo))
    return grams[anchor[lo]], whole_run, row[lo], lo - offs[row[lo]], hi - lo


def _merged(doc: np.ndarray, row: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Union of the spans [lo, lo + n + DEPTH) of each row, again as (doc, row, lo, n)."""
    if not len(doc):
        return doc, row, lo, n
    order = np.lexsort((lo, row, doc))
    doc, row, lo, end = doc[order], row[order], lo[order], lo[order] + n[order] + DEPTH
    # ends so far within a row: rows are lifted apart by more than any offset
    lift = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])])) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    new = np.concatenate([[True], lo[1:] + lift[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(new)]]) - 1
    return doc[first], row[first], lo[first], reach[last] - lift[last] - lo[first] - DEPTH


def _first(same: np.ndarray) -> np.ndarray:
    """For each row, the index of the first row of its run; same: is the row like the one before."""
    return np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))


def _like(*cols: np.ndarray) -> np.ndarray:
    same = np.ones(len(cols[0]), bool)
    for c in cols:
        same[1:] &= c[1:] == c[:-1]
    same[:1] = False
    return same


def _later(same: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Of sorted rows: those that stand after the first of their run."""
    first = _first(same)
    return same & ((doc != doc[first]) | (lo != lo[first]))


RUN_DDL = "key long, span boolean, run long, doc long, row long, lo long, n long"
SPAN_DDL = "doc long, row long, lo long, n long"


def _anchored(batches):
    """Runs of all windows of (doc, row, text); what a slice settles alone comes as spans."""
    for b in slices(batches, "text", SLICE):
        data, offs = buffers(b.column(2))
        ids, rows = (c.to_numpy(zero_copy_only=False) for c in b.columns[:2])
        parts = []
        if len(data) <= SLICE:
            g, e, at, lo, n = runs(data, offs)
            parts.append((g, e, ids[at], rows[at], lo, n))
        else:  # one long text, in pieces that share DEPTH - 1 bytes
            for start in range(0, len(data) - DEPTH + 1, SLICE - DEPTH + 1):
                own = data[start : start + SLICE]
                g, e, at, lo, n = runs(own, np.array([0, len(own)]))
                parts.append((g, e, ids[at], rows[at], lo + start, n))
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.lexsort([cols[i] for i in (3, 4, 2, 1, 0)])  # by gram, run, doc, start, row
        g, e, doc, row, lo, n = (x[order] for x in cols)
        later = _later(_like(g, e), doc, lo)
        # the first of a run goes on, with others of its doc_id and start, but once for equal rows
        on = ~later & ~_like(g, e, doc, row, lo)
        gone = _merged(doc[later], row[later], lo[later], n[later])
        spans = [_mix(gone[1].view(U) + gone[2].astype(U)), np.ones(len(gone[0]), bool), np.zeros(len(gone[0]), U), *gone]
        both = [np.concatenate([x[on], y]) for x, y in zip((g, np.zeros(len(g), bool), e, doc, row, lo, n), spans, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == U else c) for c in both], names=["key", "span", "run", "doc", "row", "lo", "n"])


def _split(batches):
    """Pass 2 over rows sorted by key, span, run, doc, lo, row: spans (key null) and the first runs to go on with."""
    kinds = (np.int64, bool, np.int64, np.int64, np.int64, np.int64, np.int64)
    rest, told = [np.zeros(0, k) for k in kinds], np.zeros(0, bool)
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.concatenate([r, c.to_numpy(zero_copy_only=False).astype(k)]) for r, c, k in zip(rest, b.columns, kinds, strict=True)]
        told = np.concatenate([told, np.zeros(b.num_rows, bool)])
        key, span, run, doc, row, lo, n = cols
        in_key = _like(key, span)
        in_run = in_key & _like(run)
        later = _later(in_run, doc, lo) & ~span
        group = np.cumsum(~in_key) - 1
        many = np.bincount(group, weights=~in_run & ~span)[group] > 1
        # runs that stand where the first of their run does, in other rows, go on at once
        level = in_run & ~span & ~later & ~_like(key, run, doc, lo, row)
        on = (~in_run & ~span & many & ~told) | level
        gone = later | (span & ~told)
        spans = _merged(doc[gone], row[gone], lo[gone], n[gone])
        found = len(spans[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.zeros(found, np.int64), key[on]]), mask=np.arange(found + on.sum()) < found)] + [pa.array(np.concatenate([x, y[on]])) for x, y in zip(spans, (doc, row, lo, n), strict=True)],
            names=["key", "doc", "row", "lo", "n"],
        )
        # the last group may go on: its last run's first row, and another run's where there is one
        own = np.flatnonzero((group == group[-1]) & ~in_run)
        keep = own[[0, -1]] if len(own) > 1 else own
        told = (told | on | span)[keep]
        rest = [c[keep] for c in cols]


WINDOWS = pa.schema([("key", pa.int64()), ("whole", pa.bool_()), ("doc", pa.int64()), ("row", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
WINDOW_DDL = "key long, whole boolean, doc long, row long, lo long, n long, data binary"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _windows(batches):
    """Text and runs of a row -> WINDOWS: runs to order together, or single windows of hot groups."""
    for b in batches:
        out = []
        for doc, row, text, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
            data = (text or "").encode()
            for w in wanted:
                lo, n = w["lo"], w["n"]
                if w["hot"]:
                    for s in range(lo, lo + n + 1):
                        own = data[s : s + DEPTH]
                        out.append((_signed(xxhash.xxh3_64_intdigest(own)), False, doc, row, s, 0, own))
                else:
                    out.append((w["key"], True, doc, row, lo, n, data[lo : lo + n + DEPTH]))
        cols = zip(*out, strict=True) if out else [[]] * len(WINDOWS)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, WINDOWS, strict=True)], schema=WINDOWS)


def radix(group: np.ndarray, at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows data[at : at + DEPTH] that another of their group equals: (index, number of the set of equals).

    Digits are eight bytes, the most significant first; a window alone in its digit leaves.
    """
    live = np.arange(len(at))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data) + 1, ">u8", padded.tobytes(), 0, (1,))
    for d in range(0, DEPTH, 8):
        digit = words[at[live] + d].astype(U)
        if d + 8 > DEPTH:
            digit >>= U(8 * (d + 8 - DEPTH))
        order = np.lexsort((digit, group))
        live, digit, group = live[order], digit[order], group[order]
        new = ~_like(group, digit)
        group = np.cumsum(new) - 1
        keep = np.bincount(group, minlength=1)[group] > 1
        live, group = live[keep], group[keep]
        if not len(live):
            break
    return live, group


def _repeats(key, doc, row, lo, n, data: list[bytes]) -> tuple[np.ndarray, ...]:
    """Pass 3: spans of the windows, of rows sorted by key in whole groups, that also start earlier under their key."""
    sizes = np.array([len(d) for d in data], np.int64)
    total, found, start = np.cumsum(sizes), [], 0
    ends = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]])) + 1  # of groups
    for end, more in zip(ends, [*ends[1:], None], strict=True):
        if more is not None and total[more - 1] - total[start] + sizes[start] <= SLICE:
            continue
        own, windows = slice(start, end), n[start:end] + 1
        of = np.repeat(np.arange(start, end), windows)
        k = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        begins = np.cumsum(sizes[own]) - sizes[own]
        live, label = radix(key[of], np.repeat(begins, windows) + k, np.frombuffer(b"".join(data[own]), np.uint8))
        d, r, s = doc[of][live], row[of][live], lo[of][live] + k[live]
        order = np.lexsort((s, d, label))
        label, d, r, s = label[order], d[order], r[order], s[order]
        later = _later(_like(label), d, s)
        found.append(_merged(d[later], r[later], s[later], np.zeros(later.sum(), np.int64)))
        start = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def _ordered(batches):
    """Pass 3 over rows sorted by key, whole, doc, lo; -> (doc, row, lo, n)."""
    rest = None

    def out(rows):
        spans = []
        for part in (rows[1], ~rows[1]):
            if part.any():
                spans.append(_repeats(*(x[part] for x in (rows[0], *rows[2:6])), [d for d, w in zip(rows[6], part, strict=True) if w]))
        cols = [np.concatenate(x) for x in zip(*spans, strict=True)] if spans else [np.zeros(0, np.int64)] * 4
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc", "row", "lo", "n"])

    for b in batches:
        if not b.num_rows:
            continue
        new = [c.to_numpy(zero_copy_only=False) for c in b.columns[:6]] + [b.column(6).to_pylist()]
        rows = new if rest is None else [np.concatenate([r, x]) if i < 6 else r + x for i, (r, x) in enumerate(zip(rest, new, strict=True))]
        last = int(np.argmax((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])))
        if last:
            yield out([r[:last] for r in rows])
        rest = [r[last:] for r in rows]
        if not rest[1][0] and len(rest[0]) > 1:  # single windows: only the first of each kind matters to what follows
            yield out(rest)
            first: dict[bytes, int] = {}
            for i, d in enumerate(rest[6]):
                first.setdefault(d, i)
            at = sorted(first.values())
            rest = [r[at] for r in rest[:6]] + [[rest[6][i] for i in at]]
    if rest is not None:
        yield out(rest)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digest(batches):
    for b in batches:
        out = [[] for _ in range(4)]
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            data = (text or "").encode()
            lo = np.array([s["lo"] for s in spans or []], np.int64)
            n = np.array([s["n"] for s in spans or []], np.int64)
            none = np.zeros(len(lo), np.int64)
            _, _, lo, n = _merged(none, none, lo, n)
            end = lo + n + DEPTH
            sha, at = hashlib.sha256(), 0
            for s, e in zip(lo.tolist(), end.tolist(), strict=True):
                sha.update(data[at:s])
                at = e
            sha.update(data[at:])
            for o, x in zip(out, (len(data), int((end - lo).sum()), len(lo), sha.hexdigest()), strict=True):
                o.append(x)
        ids = b.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([None if i == NO_ID else i for i in ids], pa.int64())] + [pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, row, lo, n): each span [lo, lo + n + DEPTH) of docs(doc, row, text) is covered; spans may overlap or repeat."""
    dealt = docs.mapInArrow(_anchored, RUN_DDL).repartition("key").sortWithinPartitions("key", "span", "run", "doc", "lo", "row")
    split = stored(dealt.mapInArrow(_split, f"key long, {SPAN_DDL}"))
    on = split.where("key is not null")
    hot = on.groupBy("key").count().where(F.col("count") > HOT_RUNS).select(F.col("key").alias("hot_key"))
    wanted = on.join(hot, F.col("key") == F.col("hot_key"), "left").groupBy("doc", "row").agg(F.collect_set(F.struct("key", "lo", "n", F.col("hot_key").isNotNull().alias("hot"))).alias("wanted"))
    windows = docs.join(wanted, ["doc", "row"]).select("doc", "row", "text", "wanted").mapInArrow(_windows, WINDOW_DDL)
    ordered = windows.repartition("key").sortWithinPartitions("key", "whole", "doc", "lo").mapInArrow(_ordered, SPAN_DDL)
    return split.where("key is null").select("doc", "row", "lo", "n").union(ordered)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs(doc_id, text)."""
    text = F.col("text").cast("string")
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))
    spans = repeated_spans(own).groupBy("doc", "row").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
    return own.join(spans, ["doc", "row"], "left").select("doc", "text", "spans").mapInArrow(_digest, RESULT)
