"""Exact top-k inner product by columnar branch-and-bound.

Vectors are quantised to floor(64 x) and kept in vertical blocks (dimension x row) of the narrowest
numbers that hold them, one byte a component where |floor(64 x)| <= 127. A task holds a cell of
candidate blocks, CELL_BYTES at most by the mean, and streams query blocks past it. Only the queries,
the small side, go to every cell; candidates move once for each of the few groups of queries that
keep all tasks busy while cells are few (`grid`), and once in all beyond. Partial inner products grow
dimension group by dimension group, and a candidate leaves a query's list once partial + |rest of
query| * |rest of candidate| (Cauchy-Schwarz) is below that query's k-th best so far, which is carried
from block to block. After each dimension group the survivors are compacted: rows and columns without
any, then single pairs once few are left. A cell gives k rows a query; these merge by (score desc,
vec_id).

Defined cases: vectors that are null or hold null or non-finite components (or ones whose 64-fold is
not finite) take no part, nor do rows with a null vec_id; a vector shorter than another counts as
zero beyond its end; scores are exact integers, and one beyond 64 bits counts as the nearest 64-bit
number; rows with the query's own vec_id (repeats too) are no candidates; equal rows of a query are
one query, unequal vectors under one query id are ranked together; ties go to the smaller vec_id;
fewer than k candidates give fewer rows; empty vectors score 0; no rows give no rows; other columns
are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.llm.common import stored

K = 20
BLOCK_ROWS = 1024
BLOCK_BYTES = 1 << 20  # of a block's numbers, where one row does not exceed it
CELL_BYTES = 128 << 20  # candidates that a task holds, as stored
FOUND_BYTES = 32  # of a result on its way to the merge, about
MOST_TASKS = 1 << 15
DIMS = 16
NARROW = 127  # components up to here are kept as bytes
SAFE = 1 << 20  # larger components stand in blocks of their own
EXACT = 1 << 53
BOUNDED = 1e100  # squares of larger components may leave the doubles
FEW = 0.05  # survivors are kept as single pairs below this share
LEAST, MOST = -(1 << 63), (1 << 63) - 1

BLOCK = pa.schema([("ids", pa.binary()), ("n", pa.int32()), ("dims", pa.binary()), ("width", pa.int32()), ("large", pa.float64())])
BLOCK_DDL = "ids binary, n int, dims binary, width int, large double"


def _kept(large: float) -> type:
    """The numbers that a block is kept in, by its largest component."""
    return np.int8 if large <= NARROW else np.int32 if large <= SAFE else np.float64


def _blocks(batches):
    """Packs rows of (vec_id, embedding) into vertical blocks of their floor(64 x)."""
    for b in batches:
        if not b.num_rows:
            continue
        ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        values = np.floor(64.0 * lists.flatten().to_numpy(zero_copy_only=False))
        starts = np.cumsum(sizes) - sizes
        large = np.array([np.abs(values[s : s + n]).max(initial=0.0) for s, n in zip(starts, sizes, strict=True)])
        out = []
        for own in (np.flatnonzero(large <= NARROW), np.flatnonzero((large > NARROW) & (large <= SAFE)), np.flatnonzero(large > SAFE)):
            most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, sizes[own].max(initial=0)))))
            for at in range(0, len(own), most):
                rows = own[at : at + most]
                width, top = int(sizes[rows].max()), float(large[rows].max())
                dims = np.zeros((width, len(rows)), _kept(top))
                for i, r in enumerate(rows):
                    dims[: sizes[r], i] = values[starts[r] : starts[r] + sizes[r]]
                out.append({"ids": ids[rows].astype(np.int64).tobytes(), "n": len(rows), "dims": dims.tobytes(), "width": width, "large": top})
        yield pa.RecordBatch.from_pylist(out, BLOCK)


class Block:
    """Rows side by side: `dims` is dimension x row, rest[i] the length of each row from dimension i * DIMS on."""

    def __init__(self, ids: bytes, n: int, dims: bytes, width: int, large: float) -> None:
        self.ids, self.large = np.frombuffer(ids, np.int64), large
        self.dims = np.frombuffer(dims, _kept(large)).reshape(width, n)
        self.rest = []
        if large <= BOUNDED:
            parts = [np.zeros(n)] + [(self.part(at, width) ** 2).sum(axis=0) for at in reversed(range(0, width, DIMS))]
            # rounded up, so that no bound falls short, by more than halving the digits loses
            short = np.float32 if large <= SAFE else np.float64
            self.rest = [(np.sqrt(x) * (1 + 1e-6)).astype(short) for x in reversed(list(np.cumsum(parts, axis=0)))]

    def part(self, at: int, end: int) -> np.ndarray:
        """The group of dimensions from `at` on, before `end`, in doubles."""
        return self.dims[at : min(at + DIMS, end)].astype(np.float64)

    def in_doubles(self, other: Block) -> bool:
        """Are inner products with another block, and their bounds, exact in doubles?"""
        common = min(len(self.dims), len(other.dims))
        return max(self.large, other.large) <= BOUNDED and common * self.large * other.large < EXACT

    def whole_numbers(self) -> np.ndarray:
        return np.array([[int(x) for x in row] for row in self.dims], object).reshape(self.dims.shape)


class Best:
    """The k best of each query so far, best first; places not yet taken hold LEAST and the id MOST."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.score, self.id = k, np.full((n, k), LEAST, np.int64), np.full((n, k), MOST, np.int64)

    def floor(self) -> np.ndarray:
        return np.where(self.id[:, -1] == MOST, -np.inf, self.score[:, -1].astype(np.float64))

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        hit = np.unique(rows)
        r = np.concatenate([np.repeat(hit, self.k), rows])
        c = np.concatenate([self.id[hit].ravel(), ids])
        s = np.concatenate([self.score[hit].ravel(), scores])
        order = np.lexsort((c, ~s, r))
        r = r[order]
        first = np.searchsorted(r, hit)
        keep = order[np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r)))) < self.k]
        self.id[hit], self.score[hit] = c[keep].reshape(-1, self.k), s[keep].reshape(-1, self.k)


def survivors(q: Block, c: Block, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, inner product) of all pairs that reach the query's floor; more may be given."""
    common = min(len(q.dims), len(c.dims))
    rows, cols = np.arange(len(q.ids)), np.arange(len(c.ids))
    if not q.in_doubles(c):
        scores = q.whole_numbers()[:common].T @ c.whole_numbers()[:common] if common else np.zeros((len(rows), len(cols)), object)
        held = np.array([min(max(int(x), LEAST), MOST) for x in scores.ravel()], np.int64)
        return np.repeat(rows, len(cols)), np.tile(cols, len(rows)), held
    partial, pairs = np.zeros((len(rows), len(cols))), None
    for i, at in enumerate(range(0, common, DIMS)):
        x, y = q.part(at, common), c.part(at, common)
        rest_q, rest_c = q.rest[i + 1], c.rest[i + 1]
        if pairs is None:
            partial += x[:, rows].T @ y[:, cols]
            alive = partial + rest_q[rows, None].astype(np.float64) * rest_c[None, cols] >= floor[rows, None]
            if alive.mean() < FEW:
                a, b = np.nonzero(alive)
                pairs, partial = (rows[a], cols[b]), partial[a, b]
            else:
                some_rows, some_cols = alive.any(axis=1), alive.any(axis=0)
                if some_rows.mean() < 0.9 or some_cols.mean() < 0.9:
                    rows, cols, partial = rows[some_rows], cols[some_cols], partial[np.ix_(some_rows, some_cols)]
        else:
            a, b = pairs
            partial = partial + np.einsum("ij,ij->j", x[:, a], y[:, b])
            keep = partial + rest_q[a].astype(np.float64) * rest_c[b] >= floor[a]
            pairs, partial = (a[keep], b[keep]), partial[keep]
    if pairs is None:
        a, b = np.nonzero(partial >= floor[rows, None])
        pairs, partial = (rows[a], cols[b]), partial[a, b]
    return *pairs, partial.astype(np.int64)


def meet(q: Block, c: Block, best: Best) -> None:
    """Takes the candidates of c into the best of q."""
    floor = best.floor()
    first = min(len(c.ids), 8 * best.k)
    common = min(len(q.dims), len(c.dims))
    if np.isneginf(floor).any() and first >= best.k and q.in_doubles(c):
        # the first columns set a floor where there is none
        seen = q.dims[:common].T.astype(np.float64) @ c.dims[:common, :first].astype(np.float64)
        seen[q.ids[:, None] == c.ids[None, :first]] = -np.inf
        floor = np.maximum(floor, np.partition(seen, first - best.k, axis=1)[:, first - best.k])
    rows, cols, scores = survivors(q, c, floor)
    other = q.ids[rows] != c.ids[cols]
    best.add(rows[other], c.ids[cols[other]], scores[other])


def _search(k: int):
    """Rows (at, side, block ...), sorted: each `at` holds a cell's blocks, then the query blocks of a group."""

    def run(batches):
        open_at, cell = None, []
        for b in batches:
            for r in b.to_pylist():
                at, side = r.pop("at"), r.pop("side")
                if at != open_at:
                    open_at, cell = at, []
                block = Block(**r)
                if side == 0:
                    cell.append(block)
                    continue
                best = Best(len(block.ids), k)
                for c in cell:
                    meet(block, c, best)
                full = best.id != MOST
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(block.ids, full.sum(axis=1))), pa.array(best.id[full]), pa.array(best.score[full])], names=["query_id", "vec_id", "score"])

    return run


def grid(candidates: int, blocks: int, queries: int, query_blocks: int, found: int, tasks: int) -> tuple[int, int]:
    """(cells, groups): as many cells as memory asks for; more, and groups, only to keep `tasks` busy.

    candidates, queries and found are bytes: found is what one cell gives for all queries. What moves is
    candidates * groups + (queries + found) * cells, least for a given number of tasks where both are equal.
    """
    least = -(-candidates // CELL_BYTES)
    even = math.isqrt(tasks * candidates // max(1, queries + found)) + 1
    cells = max(1, least, min(even, tasks, blocks))
    return cells, max(1, min(query_blocks, -(-tasks // cells)))


def top_k(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors(vec_id, embedding) whose vec_id divides by `every`."""
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(F.lit(64.0) * v) < F.lit(float("inf"))))
    ready = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False)))
    candidates = stored(ready.mapInArrow(_blocks, BLOCK_DDL))
    queries = stored(ready.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "embedding"]).mapInArrow(_blocks, BLOCK_DDL))
    total = [F.coalesce(F.sum(x), F.lit(0)).cast("long") for x in (F.length("dims") + F.length("ids"), F.col("n"))] + [F.count(F.lit(1))]
    size, _, blocks = candidates.agg(*total).first()
    query_size, query_rows, query_blocks = queries.agg(*total).first()
    cells, groups = grid(size, blocks, query_size, query_blocks, query_rows * k * FOUND_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    number = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = candidates.withColumn("cell", number(cells)).withColumn("group", all_of(groups)).withColumn("side", F.lit(0))
    right = queries.withColumn("group", number(groups)).withColumn("cell", all_of(cells)).withColumn("side", F.lit(1))
    both = left.unionByName(right).select((F.col("group") * cells + F.col("cell")).alias("at"), "side", *BLOCK.names)
    tasks = min(groups * cells, MOST_TASKS)
    dealt = both.repartitionById(tasks, F.pmod("at", F.lit(tasks)).cast("int")).sortWithinPartitions("at", "side")
    found = dealt.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
