"""Packing documents into training sequences along a space-filling curve.

A document's text becomes a hashed vector (signed counts of its 4-byte grams in DIMS dimensions);
the vector's angles, as DIMS numbers of BITS bits, give a Hilbert key, so that near keys mean like
texts. Documents are range-sorted by (Hilbert key, hash of doc_id) and laid end to end along the
curve; each range is cut into sequences of LENGTH tokens, and what is left at its end into sequences
of powers of two, so nothing is padded.

Range bounds come from approximate quantile sketches over all keys, weighted by bytes: SKETCH coarse
ranges, and in each of them up to SKETCH fine ones, so that ranges hold RANGE_BYTES of text up to
SKETCH**2 ranges, and evenly more beyond. Tokens are those of the byte-level BPE vocabulary file
given by `vocabulary` (token ids equal the tokenizers library's on that file), then END. A fast
encoder stands in for that library where both agree; texts with the vocabulary's special string or a
run of RUN white-space characters or more go to the library itself, which a worker loads at the first of them.

Defined cases: null text is empty and gives the single id END; repeated rows are packed each; a null
doc_id is packed like any other; a document longer than a sequence spans several; runs of white
space, letters, digits or signs of any length are encoded; no rows give no rows; other columns are
not read.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import buffers, slices

LENGTH = 2048
END = 1
DIMS = 3
BITS = 10
RANGE_BYTES = 8 << 20  # text in a range, about
SKETCH = 1024  # points of a sketch
RUN = 10_000
WEIGHT_BYTES = 2048
KEY_BYTES = 1 << 20
SPECIAL = "<|endoftext|>"
# Fixed value: how byte-level BPE of this vocabulary splits a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of each row of integer coordinates (Skilling 2004)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip = np.where(x[n - 1] & q, flip ^ (q - 1), flip)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def vectors(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """DIMS signed gram counts of each text, divided by the square root of its grams' number."""
    out = np.zeros((len(offs) - 1, DIMS))
    if len(data) < 4:
        return out
    wide = data.astype(np.uint32)
    grams = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    grams = (grams ^ grams >> np.uint32(15)) * np.uint32(2246822519)
    grams = (grams ^ grams >> np.uint32(13)) * np.uint32(3266489917)
    # grams over a text's end count for nobody
    starts, ends = np.minimum(offs[:-1], len(grams)), np.maximum(offs[:-1], offs[1:] - 3)
    for d in range(DIMS):
        sums = np.concatenate([[0], np.cumsum(1 - 2 * (grams >> np.uint32(31 - d) & np.uint32(1)).astype(np.int64))])
        out[:, d] = sums[np.minimum(ends, len(grams))] - sums[starts]
    return out / np.sqrt(np.maximum(1, ends - starts))[:, None]


def keys(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    v = vectors(data, offs)
    at = np.clip((np.tanh(v / 4) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(at.astype(np.int64))


def _keyed(edges):
    """(key, bytes) of each row, or with broadcast bounds (bucket, key, doc_id, text)."""

    def run(batches):
        for b in slices(batches, "text", KEY_BYTES):
            data, offs = buffers(b.column(1))
            key = keys(data, offs)
            ids = b.column(0).fill_null(-1).to_numpy().astype(np.uint64)
            salt = (ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(2 + DIMS * BITS)
            key = (key.astype(np.uint64) << np.uint64(62 - DIMS * BITS) | salt).astype(np.int64)
            if edges is None:
                # a key stands once for each begun WEIGHT_BYTES of its text; the first of them carries the size
                n = np.diff(offs)
                times = 1 + n // WEIGHT_BYTES
                size = np.zeros(times.sum(), np.int64)
                size[np.cumsum(times) - times] = n
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key, times)), pa.array(size)], names=["key", "n"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(edges.value, key)), pa.array(key), b.column(0), b.column(1)], names=["bucket", "key", "doc_id", "text"])

    return run


@cache
def library(vocabulary: str):
    """The tokenizers object of the vocabulary file; large, and loaded where a text asks for it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


@cache
def encoder(vocabulary: str):
    """encode(text) -> ids of the vocabulary file, equal to those of the tokenizers object."""
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)["model"]
    # byte-level BPE writes bytes as printable characters; merges were learned in the order of ids
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in printable)}
    byte = {c: b for b, c in char.items()}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token != SPECIAL}
    fast = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    long_run = re.compile(rf"\s{{{RUN}}}")

    def encode(text: str) -> list[int]:
        if SPECIAL in text or (len(text) >= RUN and long_run.search(text)):
            return library(vocabulary).encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cut(total: int, length: int = LENGTH) -> list[int]:
    """Lengths of the sequences that hold `total` tokens: full ones, then powers of two."""
    rest = total % length
    return [length] * (total // length) + [1 << b for b in range(length.bit_length(), -1, -1) if rest >> b & 1]


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _pack(vocabulary: str, length: int, with_ids: bool):
    """Rows (bucket, key, doc_id, text), sorted, to pieces; a bucket lies in one task."""

    def run(batches):
        encode, bucket, seq, room = encoder(vocabulary), None, 0, []
        held = []  # pieces of the open sequence: doc, start, ids, doc tokens

        def emit(rows, number, at=0):
            out = []
            for doc, start, ids, n in rows:
                raw = ids.tobytes()
                out.append((doc, start, len(ids), zlib.crc32(raw), n, number, at, raw if with_ids else None))
                at += len(ids)
            return out

        def close(rows):
            """The open sequence of a bucket's end, as powers of two."""
            nonlocal seq
            out = []
            for size in cut(sum(len(r[2]) for r in rows), length):
                own, need = [], size
                while need:
                    doc, start, ids, n = rows[0]
                    own.append((doc, start, ids[:need], n))
                    if len(ids) > need:
                        rows[0] = (doc, start + need, ids[need:], n)
                    else:
                        rows = rows[1:]
                    need -= len(own[-1][2])
                out += emit(own, bucket << 32 | seq)
                seq += 1
            return out

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)

        used = 0
        for b in batches:
            out = []
            for own, doc, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if own != bucket:
                    out += close(held)
                    bucket, seq, held, used = own, 0, [], 0
                ids = np.array([*encode(text or ""), END], "<u4")
                at = 0
                while at < len(ids):
                    part = ids[at : at + length - used]
                    held.append((doc, at, part, len(ids)))
                    at += len(part)
                    used += len(part)
                    if used == length:
                        out += emit(held, bucket << 32 | seq)
                        seq, held, used = seq + 1, [], 0
            if out:
                yield batch(out)
        if held and (out := close(held)):
            yield batch(out)

    return run


def _points(keys, n: int):
    """n - 1 approximate quantiles; the sketch merges map-side, and its size does not grow with the rows."""
    return F.percentile_approx(keys, [i / n for i in range(1, n)], 20 * n)


def bounds(sizes: DataFrame) -> np.ndarray:
    """Bounds of the ranges of sizes(key, n), n bytes a key; at most SKETCH**2 - 1."""
    total, points = sizes.agg(F.sum("n"), _points("key", SKETCH)).first()
    ranges = max(1, round((total or 0) / RANGE_BYTES))
    if ranges == 1 or not points:
        return np.zeros(0, np.int64)
    if ranges < SKETCH:
        return np.unique([points[min(SKETCH - 2, round(i * SKETCH / ranges) - 1)] for i in range(1, ranges)]).astype(np.int64)
    coarse = np.unique(points).astype(np.int64)

    def placed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(coarse, b.column(0).to_numpy())), *b.columns], names=["part", "key", "n"])

    fine = sizes.mapInArrow(placed, "part long, key long, n long").groupBy("part").agg(F.sum("n").alias("n"), _points("key", SKETCH).alias("points")).collect()  # SKETCH rows at most
    out = list(coarse)
    for r in fine:
        own = min(SKETCH, max(1, round(r.n / max(RANGE_BYTES, total / SKETCH**2))))
        out += [r.points[min(SKETCH - 2, round(i * SKETCH / own) - 1)] for i in range(1, own)]
    return np.unique(out).astype(np.int64)


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces of the sequences that hold every row of docs(doc_id, text); length: a power of two."""
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    edges = docs.sparkSession.sparkContext.broadcast(bounds(own.mapInArrow(_keyed(None), "key long, n long")))  # SKETCH**2 numbers at most
    keyed = own.mapInArrow(_keyed(edges), "bucket long, key long, doc_id long, text string")
    dealt = keyed.repartitionById(len(edges.value) + 1, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "key", "doc_id")
    found = dealt.mapInArrow(_pack(vocabulary, length, with_ids), PIECES_DDL)
    return found if with_ids else found.drop("ids")
