"""Exact dedup by composable polynomial fingerprints, confirmed by chunkwise comparison.

Texts are compared after every run of `[\\x20\\x09-\\x0D]` became one space. A text is hashed in
chunks; chunk hashes combine by length-shifted arithmetic, so chunks of a huge text may be hashed
apart. Rows whose fingerprints agree are compared chunk by chunk with their group's first row; a
group in which a row differs (a collision), or has no first row, is regrouped by SHA-256.

Only texts that share their fingerprint are read as chunks: a bit table of at most FILTER_BITS, one
bit a hash of each shared fingerprint, goes out to the scan. Its false hits only move a text in vain.

Defined cases: null text counts as empty; empty texts equal each other; repeated rows (same doc_id)
each stay one output row and count in group_size; a null doc_id stays a row of its own text group
but is chosen to stay only if no other id is in the group; no rows give no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import WHITE, buffers, checkpoint, slices, spread_join, stored

CHUNK = 1 << 16
FILTER_BITS = 1 << 28  # 32 MB, whatever the number of groups
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525)


def _powers(base: int, prime: int) -> np.ndarray:
    out = np.empty(CHUNK + 1, dtype=np.uint64)
    x = 1
    for i in range(CHUNK + 1):
        out[i] = x
        x = x * base % prime
    return out


POWERS = [_powers(b, p) for b, p in zip(BASES, PRIMES, strict=True)]


def chunk_hash(chunk: np.ndarray) -> tuple[int, int, int]:
    """Polynomial value of up to CHUNK bytes under two moduli, and their number."""
    n = len(chunk)
    wide = chunk.astype(np.uint64) + np.uint64(1)
    return (*(int(np.dot(wide, pw[:n][::-1]) % np.uint64(p)) for pw, p in zip(POWERS, PRIMES, strict=True)), n)


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """Hash of a concatenation from the hashes of its parts."""
    shifted = [(h * pow(b, right[2], p) + g) % p for h, g, b, p in zip(left[:2], right[:2], BASES, PRIMES, strict=True)]
    return shifted[0], shifted[1], left[2] + right[2]


def fingerprint(data: np.ndarray) -> tuple[int, int]:
    """(62-bit fingerprint, length) of bytes of any length."""
    h = (0, 0, 0)
    for at in range(0, len(data), CHUNK):
        h = combine(h, chunk_hash(data[at : at + CHUNK]))
    return h[0] << 31 | h[1], h[2]


def normalise(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """White-space runs to one space, for all texts of a buffer at once."""
    if not len(data):
        return data, offs
    white = WHITE[data]
    before = np.empty_like(white)
    before[1:] = white[:-1]
    before[0] = False
    before[offs[:-1][offs[:-1] < len(data)]] = False
    keep = ~(white & before)
    kept = np.concatenate([[0], np.cumsum(keep)])
    return np.where(white, np.uint8(32), data)[keep], kept[offs]


def _fingerprints(batches):
    for b in slices(batches, "text"):
        data, offs = normalise(*buffers(b.column(1)))
        fps, ns, shas = [], [], []
        for i in range(b.num_rows):
            own = data[offs[i] : offs[i + 1]]
            f, n = fingerprint(own)
            fps.append(f)
            ns.append(n)
            shas.append(hashlib.sha256(own).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), pa.array(ns, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "fp", "n", "text_sha256"])


def _slot(fp: np.ndarray, n: np.ndarray, bits: int) -> np.ndarray:
    """Where a fingerprint and length stand in a table of `bits` bits, a power of two."""
    x = (fp.astype(np.uint64) ^ n.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) & np.uint64(bits - 1)


def shared_filter(groups: DataFrame) -> np.ndarray:
    """Bit table of the fingerprints of groups(fp, n): 16 bits a group, FILTER_BITS at most."""
    bits = min(FILTER_BITS, max(64, 1 << (16 * groups.count()).bit_length()))

    def words(batches):
        for b in batches:
            at = _slot(*(c.to_numpy(zero_copy_only=False) for c in b.columns), bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    found = groups.select("fp", "n").mapInArrow(words, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()  # FILTER_BITS / 64 rows at most
    out = np.zeros(bits // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bit"].to_numpy().view(np.uint64)
    return out


def _chunks(table):
    """Chunks of the texts whose fingerprint the broadcast bit table holds."""

    def run(batches):
        for b in slices(batches, "text"):
            data, offs = normalise(*buffers(b.column(1)))
            found = np.array([fingerprint(data[offs[i] : offs[i + 1]]) for i in range(b.num_rows)], np.int64).reshape(-1, 2)
            at = _slot(found[:, 0], found[:, 1], 64 * len(table.value))
            held = np.flatnonzero(table.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1))
            own, nos, parts = [], [], []
            for i in held.tolist():
                text = data[offs[i] : offs[i + 1]]
                for k, start in enumerate(range(0, max(1, len(text)), CHUNK)):
                    own.append(i)
                    nos.append(k)
                    parts.append(text[start : start + CHUNK].tobytes())
            own = np.array(own, np.int64)
            ids = b.column(0).take(pa.array(own))
            yield pa.RecordBatch.from_arrays([ids, pa.array(found[own, 0]), pa.array(found[own, 1]), pa.array(nos, pa.int32()), pa.array(parts, pa.binary())], names=["doc_id", "fp", "n", "chunk_no", "chunk"])

    return run


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs(doc_id, text).

    Plan: one Python pass for fingerprints (checkpointed, about 100 bytes a row); an aggregate with
    map-side combine finds groups; a second pass writes the chunks of texts in groups of two or
    more, which then meet their representative's in joins that deal large groups over salts.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    fps = checkpoint(docs.mapInArrow(_fingerprints, "doc_id long, fp long, n long, text_sha256 string"))
    groups = checkpoint(fps.groupBy("fp", "n").agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    table = docs.sparkSession.sparkContext.broadcast(shared_filter(groups))
    chunks = stored(docs.mapInArrow(_chunks(table), "doc_id long, fp long, n long, chunk_no int, chunk binary"))
    first = chunks.join(groups.select("fp", "n", F.col("rep_id").alias("doc_id"), "rows"), ["fp", "n", "doc_id"])
    first = stored(first.groupBy("fp", "n", "chunk_no").agg(F.first("chunk").alias("rep_chunk"), F.first("rows").alias("rows")))
    compared = spread_join(chunks, first, ["fp", "n", "chunk_no"], "rows", ["doc_id"], "left").where("not (chunk <=> rep_chunk)")
    # false hits of the table find no first row, and no group here
    odd = checkpoint(compared.select("fp", "n").distinct().join(groups.select("fp", "n", "rows"), ["fp", "n"]).withColumn("odd", F.lit(True)))
    cls = F.when(F.col("odd"), F.col("text_sha256")).otherwise(F.lit("")).alias("cls")
    rows = spread_join(fps, odd, ["fp", "n"], "rows", ["doc_id"], "left").select("doc_id", "fp", "n", "text_sha256", cls)
    rows = checkpoint(rows)
    final = checkpoint(rows.groupBy("fp", "n", "cls").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    joined = spread_join(rows, final, ["fp", "n", "cls"], "group_size", ["doc_id"])
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
