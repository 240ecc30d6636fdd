"""Ranked lexical search with block-max pruning.

Documents are read once into a forward index: blocks of BLOCK_DOCS consecutive documents, each with its
length and its (term, count) entries for the terms that any query holds. From the index come the
collection's figures (N, L, document frequencies), which fix every weight, and each block's greatest
value of every term. A query's bound on a block is its weighted sum of these maxima.

The SEEDS blocks with the greatest bounds for a query, over all blocks, are scored first; the k-th best
of their documents is the query's threshold everywhere. Each task then takes its blocks in chunks,
sorts a chunk's blocks by the query's bound and scores them until the bound drops below the threshold,
which rises with the task's own k-th best. What is skipped cannot be among the k best, ties included.

All arithmetic is in 64-bit integers (weights: the floor of a logarithm in doubles). Queries go out as
a broadcast in groups of about GROUP_TERMS terms, whatever their number; a query's own distinct terms
must fit a task. A text is cut into words a piece at a time, so its length does not count.

Defined cases: null and empty texts have no terms and count in nothing; queries without terms have no
rows; rows of queries that share an id (null is an id) are one query over the terms of all; repeated
documents are ranked each; of equal scores a null doc_id comes last; no rows give no rows; other columns
are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.llm.common import buffers, stored

K = 50
BLOCK_DOCS = 64
SEEDS = 16
GROUP_TERMS = 1 << 18
CHUNK_CELLS = 1 << 23  # block maxima held at once
PIECE_BYTES = 1 << 20
LAST = np.iinfo(np.int64).max  # stands for a null doc_id

# Fixed value: what parts terms; only A-Z are lower-cased, all bytes beyond ASCII belong to terms.
PARTS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
FOLD = bytes(0x20 if b in PARTS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
PART = re.compile(b"[" + b"".join(b"\\x%02x" % b for b in PARTS) + b"]")

INDEX = "block long, n_docs long, n_terms long, docs array<long>, lengths array<long>, starts array<int>, terms array<int>, counts array<int>, held array<int>, held_docs array<int>"


def words(view: memoryview, start: int, end: int) -> Iterator[list[bytes]]:
    """The terms of view[start:end], a piece at a time."""
    while start < end:
        cut = PART.search(view, start + PIECE_BYTES, end) if end - start > PIECE_BYTES else None
        to = cut.start() if cut else end
        yield bytes(view[start:to]).translate(FOLD).split()
        start = to


def _terms(batches):
    for b in batches:
        data, offs = buffers(b.column(1))
        found = [(row, t) for row in range(b.num_rows) for t in {t for piece in words(memoryview(data), int(offs[row]), int(offs[row + 1])) for t in piece}]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r for r, _ in found], pa.int64())), pa.array([t for _, t in found], pa.binary())], names=["item_id", "term"])


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of items(item_id, text), each once."""
    own = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(_terms, "item_id long, term binary").distinct()


def _index(vocabulary):
    """Rows (doc_id, text) to blocks; held: the block's terms, held_docs: in how many of its documents."""

    def run(batches):
        known = vocabulary.value.get
        number, docs, lengths, starts, terms, counts, n_docs, n_terms = TaskContext.get().partitionId() << 32, [], [], [], [], [], 0, 0

        def block():
            held, in_docs = np.unique(np.array(terms, np.int32), return_counts=True)
            cols = [[number], [n_docs], [n_terms], [docs], [lengths], [starts], [terms], [counts], [held], [in_docs.astype(np.int32)]]
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.int32())] * 5
            names = [c.split()[0] for c in INDEX.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for b in batches:
            data, offs = buffers(b.column(1))
            view = memoryview(data)
            for row, doc in enumerate(b.column(0).to_pylist()):
                found = Counter()
                for piece in words(view, int(offs[row]), int(offs[row + 1])):
                    found.update(map(known, piece))
                length = found.total()
                found.pop(None, None)
                n_docs, n_terms = n_docs + (length > 0), n_terms + length
                if found:
                    docs.append(doc)
                    lengths.append(length)
                    starts.append(len(terms))
                    terms += found.keys()
                    counts += found.values()
                if len(docs) == BLOCK_DOCS:
                    yield block()
                    number, docs, lengths, starts, terms, counts, n_docs, n_terms = number + 1, [], [], [], [], [], 0, 0
        if n_docs:
            yield block()

    return run


def value(counts: np.ndarray, lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term's occurrences in a document are worth before its weight."""
    wide = lengths.astype(object) if len(lengths) and 50 * int(lengths.max()) * n >= 1 << 63 else lengths
    m = 50 + (50 * wide * n // total).astype(np.int64)
    return 1_000_000_000 * counts // (1000 * counts + 20 * m)


class _Chunk:
    """Blocks of a task: their entries with values, and each block's maxima over `size` terms."""

    def __init__(self, rows: list[dict], n: int, total: int, size: int):
        self.numbers = [r["block"] for r in rows]
        self.docs, self.starts, self.terms, self.values = [], [], [], []
        self.maxima = np.zeros((len(rows), size), np.int64)
        for i, r in enumerate(rows):
            docs, lengths, starts, terms, counts = (r[c] for c in ("docs", "lengths", "starts", "terms", "counts"))
            per_doc = np.diff(np.append(starts, len(terms)))
            values = value(counts.astype(np.int64), np.repeat(lengths, per_doc), n, total)
            np.maximum.at(self.maxima[i], terms, values)
            for held, own in zip((self.docs, self.starts, self.terms, self.values), (docs, starts, terms, values), strict=True):
                held.append(own)

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return self.maxima[:, terms] @ weights

    def scores(self, blocks: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """doc_ids and scores of all documents in blocks; dense: a weight for every term, 0 if the query does not hold it."""
        docs = np.concatenate([self.docs[i] for i in blocks])
        sizes = np.cumsum([0, *[len(self.terms[i]) for i in blocks]])
        starts = np.concatenate([self.starts[i] + s for i, s in zip(blocks, sizes, strict=False)])
        worth = dense[np.concatenate([self.terms[i] for i in blocks])] * np.concatenate([self.values[i] for i in blocks])
        return docs, np.add.reduceat(worth, starts)


def _chunks(batches, n: int, total: int, size: int) -> Iterator[_Chunk]:
    """A task's blocks, CHUNK_CELLS of maxima at a time."""
    rows, most = [], max(1, CHUNK_CELLS // max(1, size))
    for b in batches:
        cols = {c: b.column(b.schema.get_field_index(c)) for c in ("docs", "lengths", "starts", "terms", "counts")}
        for i, number in enumerate(b.column(b.schema.get_field_index("block")).to_pylist()):
            row = {c: np.asarray((v[i].values.fill_null(LAST) if c == "docs" else v[i].values).to_numpy()) for c, v in cols.items()}
            if not len(row["docs"]):
                continue
            rows.append(row | {"block": number})
            if len(rows) == most:
                yield _Chunk(rows, n, total, size)
                rows = []
    if rows:
        yield _Chunk(rows, n, total, size)


def _best(docs: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((docs, -scores))[:k]


def _bounds(shared):
    """Each query's SEEDS best bounds in a chunk."""

    def run(batches):
        queries, _, n, total, size = shared.value
        for chunk in _chunks(batches, n, total, size):
            out = []
            for q, (terms, weights) in enumerate(queries):
                bound = chunk.bounds(terms, weights)
                out += [(q, int(bound[i]), chunk.numbers[i]) for i in np.argsort(-bound, kind="stable")[:SEEDS] if bound[i] > 0]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["query", "bound", "block"])

    return run


def _search(shared, k: int, wanted=None):
    """(query, doc_id, score) of a task's documents that may be among the k best; wanted: the queries of each block, if not all."""

    def run(batches):
        queries, floors, n, total, size = shared.value
        found = {}  # query: docs and scores of its best so far
        floor, dense = list(floors), np.zeros(size, np.int64)
        for chunk in _chunks(batches, n, total, size):
            asked = range(len(queries)) if wanted is None else sorted({q for b in chunk.numbers for q in wanted.value.get(b, ())})
            for q in asked:
                terms, weights = queries[q]
                bound = chunk.bounds(terms, weights)
                if wanted is not None:
                    bound[[q not in wanted.value.get(b, ()) for b in chunk.numbers]] = 0
                order = np.argsort(-bound, kind="stable")
                dense[terms] = weights
                at, wave = 0, 8
                while at < len(order):
                    # blocks in the order of their bounds; a bound equal to the threshold may hide a tie
                    wave_blocks = order[at : at + wave]
                    wave_blocks = wave_blocks[bound[wave_blocks] >= max(1, floor[q])]
                    if not len(wave_blocks):
                        break
                    docs, scores = chunk.scores(wave_blocks, dense)
                    keep = scores >= max(1, floor[q])
                    if keep.any():
                        old = found.get(q)
                        docs, scores = docs[keep], scores[keep]
                        if old is not None:
                            docs, scores = np.concatenate([old[0], docs]), np.concatenate([old[1], scores])
                        best = _best(docs, scores, k)
                        found[q] = docs[best], scores[best]
                        if len(best) == k:
                            floor[q] = max(floor[q], int(scores[best[-1]]))
                    at, wave = at + len(wave_blocks), wave * 2
                dense[terms] = 0
        for q, (docs, scores) in found.items():
            ids = pa.array(docs, mask=docs == LAST)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), q)), ids, pa.array(scores)], names=["query", "doc_id", "score"])

    return run


RESULT = "query long, doc_id long, score long"


def _ranked(docs: DataFrame, asked: list[tuple[int | None, bytes]], k: int) -> DataFrame | None:
    """The result for one group of queries; asked: (item_id, term) in order of item_id."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    terms = {t: i for i, t in enumerate(sorted({t for _, t in asked}))}
    ids = list(dict.fromkeys(i for i, _ in asked))
    index = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_index(share(terms)), INDEX))
    n, total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not total:
        return None
    held = index.select(F.explode(F.arrays_zip("held", "held_docs")).alias("x")).groupBy("x.held").agg(F.sum("x.held_docs").alias("df"))
    df = {r.held: r.df for r in held.collect()}  # at most as many rows as the group has terms
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(terms))], np.int64)
    own = {i: [] for i in ids}
    for i, t in asked:
        own[i].append(terms[t])
    queries = [(np.array(own[i], np.int64), weight[own[i]]) for i in ids]

    shared = share((queries, [0] * len(ids), n, total, len(terms)))
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    bounds = index.mapInArrow(_bounds(shared), "query long, bound long, block long").withColumn("turn", F.row_number().over(order))
    seeds = bounds.where(F.col("turn") <= SEEDS).select("query", "block").collect()  # SEEDS rows a query
    wanted = {}
    for r in seeds:
        wanted.setdefault(r.block, set()).add(r.query)
    first = F.broadcast(spark.createDataFrame([(b,) for b in wanted], "block long"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = index.join(first, "block", "left_semi").mapInArrow(_search(shared, k, share(wanted)), RESULT).withColumn("rank", F.row_number().over(best))
    floors = [0] * len(ids)
    for r in top.where(F.col("rank") == k).collect():  # a row a query
        floors[r["query"]] = r.score

    shared = share((queries, floors, n, total, len(terms)))
    found = index.mapInArrow(_search(shared, k), RESULT).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = F.broadcast(spark.createDataFrame(list(enumerate(ids)), "query long, item_id long"))
    return found.join(names, "query").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of docs(doc_id, text) for each of items(item_id, text)."""
    terms = stored(query_terms(items))
    groups = max(1, math.ceil(terms.count() / GROUP_TERMS))
    grouped = terms.withColumn("group", F.pmod(F.xxhash64(F.col("item_id")), F.lit(groups)))
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for g in range(groups):
        asked = [(r.item_id, bytes(r.term)) for r in grouped.where(F.col("group") == g).orderBy(F.col("item_id").asc_nulls_last(), "term").collect()]
        if asked and (found := _ranked(docs, asked, k)) is not None:
            out = out.union(found)
    return out
