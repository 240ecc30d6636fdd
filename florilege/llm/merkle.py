"""A Merkle manifest of a dataset, with every document's proof checked by coordinate lookups.

A row's leaf is the SHA-256 of its columns' encodings. The leaves of each language, by doc_id, are
numbered without one task holding them all: a range partitioning, and prefix sums over its parts.
Every FAN consecutive nodes of a level become one node of the next, until one is left, the subroot;
the subroots, by language, form one more tree in the same way, whose last node is the root.

A proof holds the siblings of a leaf and of all nodes above it. Leaves of one run share all of it but
the run's own leaves, so the run explodes the required coordinates (level, index), which follow from
its index and the number of leaves, once for its leaves; they are joined to the materialised table of
nodes, ordered and concatenated. Coordinates are looked up BLOCK levels at a time: the node above that
has looked up the next levels itself, so none is asked for by more than FAN**BLOCK others, whatever
the height of the tree or the size of a language. Each leaf, tampered with or not, then folds through
its siblings to a root.

Defined cases: a null column is encoded as `-`, an empty text as `0:`; a null lang is a language, the
first; null doc_ids come first; rows that share a doc_id are ordered by leaf; equal rows are leaves
each; a lone leaf is its language's subroot, a lone subroot the root; a null doc_id is not tampered
with; texts of any length are hashed whole; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.llm.common import stored

FAN = 8
BITS = 3  # of an index, each level
BLOCK = 3
MOST_LEVELS = 20  # FAN**20 is beyond any number of rows
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """The leaf of a row, some of its columns replaced."""
    return F.sha2(F.concat(*[encoded(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def tampered() -> Column:
    """The leaf of a row whose text's letters A-Z were made lower-case, if 3 divides the CRC-32 of its doc_id; else null."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf(text=F.translate("text", string.ascii_uppercase, string.ascii_lowercase)))


def depth(n: Column) -> Column:
    """Levels above the leaves in a tree of n leaves."""
    return sum(((n > FAN**level).cast("int") for level in range(MOST_LEVELS)), F.lit(0))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds `idx`, a row's place in its `tree`, and `n`, the tree's rows."""
    ranged = stored(rows.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"))
    # a tree has as many rows here as there are partitions, at most
    whole = Window.partitionBy("tree")
    upto = whole.orderBy("part")
    parts = parts.select("tree", "part", (F.sum("rows").over(upto) - F.col("rows")).alias("before"), F.sum("rows").over(whole).alias("n"))
    turn = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order)) - 1
    return ranged.withColumn("turn", turn).join(parts, ["tree", "part"]).withColumn("idx", F.col("before") + F.col("turn")).drop("part", "turn", "before")


def _parent(children: Column) -> Column:
    """The hash over children(pos, hash) in order of pos."""
    return F.sha2(F.array_join(F.transform(children, lambda c: c["hash"]), ""), 256)


def grow(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """runs(tree, n, idx, members, hash), nodes(tree, n, level, idx, hash) from level 1 up, subroots(tree, hash) of rows(tree, n, idx, hash, item)."""
    members = F.sort_array(F.collect_list(F.struct(F.col("idx").alias("pos"), "hash", "item")))
    runs = rows.groupBy("tree", "n", F.shiftright("idx", BITS).alias("up")).agg(members.alias("members")).withColumnRenamed("up", "idx")
    runs = stored(runs.withColumn("hash", F.when(F.col("n") == 1, F.col("members")[0]["hash"]).otherwise(_parent(F.col("members")))))
    level = runs.where("n > 1").select("tree", "n", F.lit(1).alias("level"), "idx", "hash")
    nodes, most, at = level, runs.agg(F.max("n")).first()[0] or 0, 1
    while most > FAN**at:
        children = F.sort_array(F.collect_list(F.struct(F.col("idx").alias("pos"), "hash")))
        level = level.where(F.col("n") > FAN**at).groupBy("tree", "n", F.shiftright("idx", BITS).alias("up")).agg(children.alias("children"))
        at += 1
        level = stored(level.select("tree", "n", F.lit(at).alias("level"), F.col("up").alias("idx"), _parent(F.col("children")).alias("hash")))
        nodes = nodes.union(level)
    subroots = nodes.where(F.col("level") == depth(F.col("n"))).union(runs.where("n = 1").select("tree", "n", F.lit(0), "idx", "hash"))
    return runs, nodes, subroots.select("tree", "hash")


def _siblings(rows: DataFrame, nodes: DataFrame, at: int) -> DataFrame:
    """(tree, idx, found) of rows(tree, n, idx), nodes of level `at`: their siblings and those of the nodes above, BLOCK levels at most."""
    top = F.least(F.lit(at + BLOCK), depth(F.col("n"))) - 1
    levels = rows.where(top >= at).select("tree", "n", "idx", F.explode(F.sequence(F.lit(at), top)).alias("level"))
    width = F.expr(f"shiftright(n + shiftleft(1L, {BITS} * level) - 1, {BITS} * level)")
    own = F.expr(f"shiftright(idx, {BITS} * (level - {at}))")
    first = F.shiftleft(F.shiftright(own, BITS), BITS)
    run = F.sequence(first, F.least(first + (FAN - 1), width - 1))
    wanted = levels.select("tree", "idx", "level", own.alias("own"), F.explode(F.filter(run, lambda j: j != own)).alias("sibling"))
    held = nodes.select("tree", "level", F.col("idx").alias("sibling"), "hash")
    found = F.sort_array(F.collect_list(F.struct("level", "sibling", "own", "hash")))
    return wanted.join(held, ["tree", "level", "sibling"]).groupBy("tree", "idx").agg(found.alias("found"))


def _steps(found: Column, at: int) -> Column:
    """A step (left, right) for each level from `at` on: the siblings' hashes on either side, none where a node is alone in its run."""
    top = F.least(F.lit(at + BLOCK), depth(F.col("n"))) - 1

    def side(level, left: bool):
        here = F.filter(found, lambda x: (x["level"] == level) & ((x["sibling"] < x["own"]) if left else (x["sibling"] > x["own"])))
        return F.coalesce(F.array_join(F.transform(here, lambda x: x["hash"]), ""), F.lit(""))

    steps = F.transform(F.sequence(F.lit(at), top), lambda level: F.struct(side(level, True).alias("left"), side(level, False).alias("right")))
    return F.when(top >= at, steps).otherwise(F.array().cast("array<struct<left:string,right:string>>"))


def proofs(runs: DataFrame, nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """(tree, hash, item, path, rest of tops) of each member of runs; path: steps to the subroot, then those of tops(tree, path, ...)."""
    most, kept = runs.agg(F.max("n")).first()[0] or 0, [c for c in tops.columns if c not in ("tree", "path")]
    blocks = [at for at in range(1, MOST_LEVELS, BLOCK) if at == 1 or most > FAN**at]
    found = None
    for at in reversed(blocks):
        rows = runs if at == 1 else nodes.where((F.col("level") == at) & (depth(F.col("n")) > at)).select("tree", "n", "idx")
        ends = depth(F.col("n")) <= at + BLOCK
        above = tops.withColumn("above", F.lit(-1).cast("long"))
        if found is not None:
            above = above.unionByName(found.withColumnRenamed("idx", "above"))
        own = rows.join(_siblings(rows, nodes, at), ["tree", "idx"], "left").withColumn("above", F.when(ends, F.lit(-1)).otherwise(F.shiftright("idx", BITS * BLOCK)))
        own = own.join(above, ["tree", "above"]).withColumn("path", F.concat(_steps(F.col("found"), at), "path"))
        found = own.select("tree", "idx", "path", *kept, *(["members", (F.col("n") == 1).alias("lone")] if at == 1 else []))
        if at > 1:
            found = stored(found)
    near = F.struct(
        F.array_join(F.transform(F.filter("members", lambda m: m["pos"] < F.col("pos")), lambda m: m["hash"]), "").alias("left"),
        F.array_join(F.transform(F.filter("members", lambda m: m["pos"] > F.col("pos")), lambda m: m["hash"]), "").alias("right"),
    )
    each = found.select("*", F.inline("members"))
    return each.select("tree", "hash", "item", F.when(F.col("lone"), F.col("path")).otherwise(F.concat(F.array(near), "path")).alias("path"), *kept)


def fold(start: Column) -> Column:
    """The root that `start` and the siblings of `path` give."""
    return F.aggregate("path", start, lambda got, s: F.sha2(F.concat(s["left"], got, s["right"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs(doc_id, source, lang, n_chars, text)."""
    item = F.struct(F.col("doc_id").cast("long").alias("doc_id"), tampered().alias("changed"))
    # null sorts before any language
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    leaves = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("hash"), item.alias("item"))
    runs, nodes, subroots = grow(numbered(leaves, "doc_id", "hash").drop("doc_id"))

    crowns = subroots.select(F.lit("").alias("tree"), "hash", F.col("tree").alias("item"))
    crown, crown_nodes, root = grow(numbered(crowns, "item"))
    none = root.select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("hash").alias("root"))
    tops = proofs(crown, crown_nodes, none).select(F.col("item").alias("tree"), F.col("hash").alias("subroot"), "root", "path")

    found = proofs(runs, nodes, stored(tops))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    folded = fold(F.coalesce("item.changed", "hash"))
    out = found.select("item.doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
