"""Documents by class: one row a class with its size and a few members, one row a member, in place of lists or pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions import text as T
from florilege.operators import conflicts as C
from florilege.sources.tables import stored

SAMPLE = 5


def classes(members: DataFrame, *key: str, sample: int = SAMPLE) -> DataFrame:
    """(key..., documents, paths) of members(key..., path): each class of two paths or more, with its least paths.

    The count and the choice of the least paths are both made before the shuffle, so a class of any
    size reaches its task as a few rows of each partition.
    """
    distinct = members.select(*key, "path")
    sizes = distinct.groupBy(*key).agg(F.count(F.lit(1)).alias("documents")).where("documents > 1")
    turn = F.row_number().over(Window.partitionBy(*key).orderBy("path"))
    least = distinct.withColumn("turn", turn).where(F.col("turn") <= sample).groupBy(*key).agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return sizes.join(least, list(key))


def duplicate_id_members(docs: DataFrame) -> DataFrame:
    """(id, path) of all documents with an id, as it is compared."""
    return docs.select(F.trim("id").alias("id"), "path").where("id <> ''")


def exact_members(docs: DataFrame) -> DataFrame:
    """(content_hash, path) of all documents."""
    return docs.select(T.content_hash(F.col("body")).alias("content_hash"), "path")


def value_members(docs: DataFrame) -> DataFrame:
    """(key, value, path): each fact of an eligible document, once; keys with several values are contradictions."""
    return C.asserted(C.live_facts(docs)).select("key", "value", "path")


def contradiction_classes(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(key, severity, label, value, documents, paths): every value of a contradicted key, with its number of documents and the least of them."""
    members = stored(value_members(docs))
    sizes = members.groupBy("key", "value").agg(F.count(F.lit(1)).alias("documents"))
    several = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("values")).where("values > 1").select("key")
    turn = F.row_number().over(Window.partitionBy("key", "value").orderBy("path"))
    least = members.join(several, "key", "left_semi").withColumn("turn", turn).where(F.col("turn") <= sample).groupBy("key", "value").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return sizes.join(least, ["key", "value"]).select("key", C.fact_severity(F.col("key")).alias("severity"), C.fact_label(F.col("key")).alias("label"), "value", "documents", "paths")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that links(a, b) lead to, for every node that they name.

    Each round takes the least root among a node's neighbours, then the root of that root, so that
    chains shorten by half; both are aggregates with partial minima. Rounds end when no root changes.
    """
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))  # not a union, which would find the links twice
    edges = stored(links.where("a <> b").select(F.inline(both)).distinct())
    roots = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = edges.join(roots, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = roots.join(near, "node").select("node", F.least("root", "near").alias("to"), F.col("root").alias("was"))
        jump = roots.select(F.col("node").alias("to"), F.col("root").alias("beyond"))
        step = stored(lower.join(jump, "to", "left").select("node", F.least("to", "beyond").alias("root"), "was"))
        changed = step.where("root <> was").limit(1).count()
        roots = step.select("node", "root")
        if not changed:
            return roots


def near_duplicate_members(docs: DataFrame, threshold: float = C.THRESHOLD) -> DataFrame:
    """(path, cluster, body) of all documents that have a near or an equal copy.

    cluster is the least path of all documents that near duplicates lead to; body the least path of
    those with the same body, which alone take part in the comparison.
    """
    hashed = docs.select("path", T.content_hash(F.col("body")).alias("h"))
    first = hashed.groupBy("h").agg(F.min("path").alias("body"), F.count(F.lit(1)).alias("copies"))
    found = components(C.near_duplicates(docs, threshold)).toDF("body", "cluster")
    rows = hashed.join(first, "h").join(found, "body", "left").where("copies > 1 or cluster is not null")
    return rows.select("path", F.coalesce("cluster", "body").alias("cluster"), "body")
