"""SimHash near-dedup through deletion-variant signatures.

A fingerprint has 64 bits, each the majority of that bit over the XXH64 values (seed 42) of the
4-word shingles of the A-Z-lower-cased text. Two fingerprints within 4 bits differ, in one of three
segments, by at most one bit. So each distinct fingerprint is indexed under its three segments and
under every segment with one bit taken out; equal keys meet, distances are verified, and each bucket
gives a spanning forest of its links rather than all its pairs. Components come from
`components.components`.

Defined cases: null and empty texts have fingerprint zero and link like any other; texts of fewer
than four words hash as one shingle; repeated rows stay separate rows of one component; a null
doc_id gets its component's least doc_id; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import buffers, checkpoint, slices, spread_join
from florilege.llm.components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))
SMALL = 16
PIECE = 1 << 16


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of each shingle of a text, in order, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - SHINGLE + 1].tolist()
    ends = ends[SHINGLE - 1 :].tolist()
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64, len(starts))


def majority(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of hashes; counts are the runs' lengths, all at least 1."""
    out = np.zeros(len(counts), np.uint64)
    for bit in range(64):
        ones = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), starts)
        out |= (2 * ones > counts).astype(np.uint64) << np.uint64(bit)
    return out


def _fingerprints(batches):
    """The columns before the last, a text, and its fingerprint."""
    for b in slices(batches, "text"):
        data, offs = buffers(b.column(b.num_columns - 1))
        raw = data.tobytes()
        hashed = [shingle_hashes(raw[offs[i] : offs[i + 1]]) for i in range(b.num_rows)]
        counts = np.array([len(h) for h in hashed], np.int64)
        fps, some = np.zeros(len(counts), np.uint64), np.flatnonzero(counts)
        if len(some):
            fps[some] = majority(np.concatenate(hashed), np.concatenate([[0], np.cumsum(counts[some])[:-1]]), counts[some])
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], names=[*b.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _signatures(batches):
    """(key, side, fp): side is the bit taken out, or 2 where the whole segment is the key."""
    for b in batches:
        fp = b.column(0).to_numpy().view(np.uint64)
        keys, sides, code = [], [], 0
        for at, width in SEGMENTS:
            own = (fp >> np.uint64(at)) & np.uint64((1 << width) - 1)
            keys.append(own | np.uint64(code << 32))
            sides.append(np.full(len(fp), 2, np.int8))
            code += 1
            for i in range(width):
                keys.append(own & ~np.uint64(1 << i) | np.uint64(code << 32))
                sides.append(((own >> np.uint64(i)) & np.uint64(1)).astype(np.int8))
                code += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sides)), pa.array(np.tile(fp, code).view(np.int64))], names=["key", "side", "fp"])


def _forest(fp: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links of one bucket that connect all its members that are linked: a breadth-first forest."""
    left, edges = np.arange(len(fp)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[x]) <= RADIUS
            if side[x] != 2:
                near &= side[left] != side[x]
            edges += [(x, y) for y in left[near]]
            queue += list(left[near])
            left = left[~near]
    return edges


def bucket_links(key: np.ndarray, side: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of rows sorted by key; large buckets give forests."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(edge)
    a, b = [], []
    small = np.repeat(size <= SMALL, size) & np.repeat(size > 1, size)
    k, s, f = key[small], side[small], fp[small]
    for d in range(1, SMALL):
        near = k[d:] == k[:-d]
        if not near.any():
            break
        near &= (s[d:] == 2) | (s[d:] != s[:-d])
        near &= np.bitwise_count(f[d:] ^ f[:-d]) <= RADIUS
        a.append(f[:-d][near])
        b.append(f[d:][near])
    for i in np.flatnonzero(size > SMALL):
        own = slice(edge[i], edge[i + 1])
        if found := _forest(fp[own], side[own]):
            x, y = np.array(found).T
            a.append(fp[own][x])
            b.append(fp[own][y])
    none = np.zeros(0, np.uint64)
    a, b = np.concatenate([none, *a]), np.concatenate([none, *b])
    low, high = np.minimum(a, b), np.maximum(a, b)
    pairs = np.unique(np.stack([low, high], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _links(batches):
    rest = [np.zeros(0, t) for t in (np.int64, np.int8, np.uint64)]

    def out(cols):
        a, b = bucket_links(*cols) if len(cols[0]) else cols[2:] * 2
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rest = [np.concatenate([r, n.view(r.dtype)]) for r, n in zip(rest, new, strict=True)]
        last = np.searchsorted(rest[0], rest[0][-1])  # the last bucket may go on
        if last:
            yield out([r[:last] for r in rest])
            rest = [r[last:] for r in rest]
    yield out(rest)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links among the distinct fingerprints, enough to connect all that are within RADIUS bits."""
    keyed = distinct.select("fp").mapInArrow(_signatures, "key long, side byte, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long").distinct()


def classes(fps: DataFrame, least) -> DataFrame:
    """(fp, rows, least, label) of each distinct fingerprint of fps(fp, ...): the least of `least` over its rows, its component."""
    nodes = checkpoint(fps.groupBy("fp").agg(F.min(least).alias("least"), F.count(F.lit(1)).alias("rows")))
    labels = components(links(nodes))
    return checkpoint(nodes.join(labels, nodes.fp == labels.node, "left").select("fp", "rows", "least", F.coalesce("label", "fp").alias("label")))


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs(doc_id, text)."""
    fps = checkpoint(fingerprints(docs))
    whole = classes(fps, F.col("doc_id"))
    ids = checkpoint(whole.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("fps")))
    final = checkpoint(spread_join(whole, ids, ["label"], "fps", ["fp"]).select("fp", "rows", "component_id"))
    return spread_join(fps, final, ["fp"], "rows", ["doc_id"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with one row of each component, whatever its columns.

    The row with the least doc_id stays, a null one only where the component has no other; of rows
    that share it, the one whose hash over all columns is least; of rows equal in all columns, one.
    """
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(*plain).alias("h"))
    fps = checkpoint(rows.select("doc", "h", F.col("row.text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc long, h long, fp long"))
    first = classes(fps, F.struct(F.col("doc").isNull().alias("none"), "doc", "h")).groupBy("label").agg(F.min("least").alias("stay")).select("stay.doc", "stay.h")
    copies = fps.groupBy("doc", "h").agg(F.count(F.lit(1)).alias("rows"))
    stay = checkpoint(first.alias("a").join(copies.alias("b"), F.col("a.doc").eqNullSafe(F.col("b.doc")) & (F.col("a.h") == F.col("b.h"))).select("a.doc", "a.h", "rows"))
    same = lambda side: rows.doc.eqNullSafe(side.doc) & (rows.h == side.h)
    single, repeated = stay.where("rows = 1"), stay.where("rows > 1")
    once = rows.join(single, same(single), "left_semi").select("row")
    again = rows.join(repeated, same(repeated), "left_semi").groupBy("doc", "h").agg(F.any_value("row").alias("row")).select("row")
    return once.unionAll(again).select("row.*")
