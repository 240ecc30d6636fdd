"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import checkpoint

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges(a, b); label is the least node of its component.

    Each round is a few aggregates and joins over the edges, which never exceed their first number;
    rounds grow with the logarithm of the longest chain. Repeated edges are harmless; self-loops are
    left out, so a node with no other edge has no row.
    """
    state = checkpoint(edges.select("a", "b").where("a <> b").distinct())
    sign = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
    last = sign(state)
    for _ in range(MAX_ROUNDS):
        if not last[0]:
            break
        state = checkpoint(_small_star(_large_star(state)).distinct())
        now = sign(state)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("label"))
    return state.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots).groupBy("node").agg(F.min("label").alias("label"))
