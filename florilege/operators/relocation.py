"""Where the files of a dead glob went, by the renames that history shows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions import globs as G
from florilege.operators import globjoin
from florilege.sources.tables import stored


def _split_fixed(glob: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([G.split_fixed(g) for g in glob.fillna("")], columns=["prefix", "rest", "literal"])


def trees_as_of(commit_files: DataFrame, commits: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rev, path) of the trees of all wanted(rev, commit_ts, sha) at once: what the commits before each leave, by (commit_ts, sha).

    Each commit learns how many wanted revisions do not lie after it, by a prefix sum over range
    partitions of both together. A change of a path then holds for the wanted revisions from its own
    number to that of the path's next change, and is repeated for these alone: no change meets a
    revision that it does not belong to, and there is neither a range join nor a broadcast.
    change_type D removes a path.
    """
    marks = commits.select("sha", "commit_ts", F.lit(0).alias("mark"), F.lit(None).cast("string").alias("rev"))
    marks = marks.unionByName(wanted.select("sha", "commit_ts", F.lit(1).alias("mark"), "rev"))
    # a wanted revision comes before the commit of the same place
    ranks = stored(running_sum(marks, [F.col("commit_ts"), F.col("sha"), F.desc("mark"), F.col("rev")], "mark", "rank"))
    places = ranks.where("mark = 1").select("rev", (F.col("rank") - 1).alias("rank"))
    changes = commit_files.join(ranks.where("mark = 0").select("sha", "commit_ts", "rank"), "sha")
    # a window without a key over one row: the number of wanted revisions
    total = wanted.agg(F.count(F.lit(1)).alias("total"))
    after = F.lead("rank").over(Window.partitionBy("path").orderBy("commit_ts", "sha"))
    spans = changes.withColumn("after", after).join(F.broadcast(total)).withColumn("after", F.coalesce("after", "total"))
    held = spans.where((F.col("change_type") != "D") & (F.col("rank") < F.col("after")))
    return held.select("path", F.explode(F.sequence("rank", F.col("after") - 1)).alias("rank")).join(places, "rank").select("rev", "path")


def running_sum(rows: DataFrame, order: list, of: str, name: str) -> DataFrame:
    """Adds the sum of `of` over all rows up to a row in `order`, by range partitions, so that no task holds all rows."""
    parts = stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy("_part").agg(F.sum(of).alias("_all"))
    # one row for each partition: as many rows as spark.sql.shuffle.partitions at most
    before = totals.select("_part", (F.sum("_all").over(Window.orderBy("_part")) - F.col("_all")).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.sum(of).over(inside)).drop("_part", "_before")


def links(dead: DataFrame, old_files: DataFrame, renames: DataFrame, tracked: DataFrame) -> DataFrame:
    """(glob, old_path, new_path, similarity, files): every file of a dead glob, and where it is now if known."""
    before = globjoin.match(dead, old_files).withColumnRenamed("path", "old_path")
    sizes = before.groupBy("glob").agg(F.count(F.lit(1)).cast("int").alias("files"))
    alive = renames.join(tracked.select(F.col("path").alias("new_path")), "new_path", "left_semi")
    return before.join(alive, "old_path", "left").join(sizes, "glob").select("glob", "old_path", "new_path", "similarity", "files")


def votes(linked: DataFrame) -> DataFrame:
    """(glob, home, moved, lowest, files, place, tied): new folders of a glob's files, most files first."""
    parts = linked.where("new_path is not null").withColumn("s", F.pandas_udf(_split_fixed, "prefix string, rest string, literal boolean")("glob"))
    tail = F.substr(F.col("old_path"), F.length("s.prefix") + 1)
    home = F.left(F.col("new_path"), F.length("new_path") - F.length(tail))
    homes = parts.withColumn("home", home).where(
        F.col("new_path").endswith(tail) & (F.col("s.literal") | (F.col("home") == "") | F.col("home").endswith("/")) & (F.concat("home", tail) != F.col("old_path"))
    )
    counted = homes.groupBy("glob", "home").agg(F.count(F.lit(1)).cast("int").alias("moved"), F.min("similarity").cast("int").alias("lowest"), F.first("files").alias("files"), F.first("s").alias("s"))
    place = F.rank().over(Window.partitionBy("glob").orderBy(F.desc("moved")))
    counted = counted.withColumn("place", place)
    return counted.withColumn("tied", F.count(F.lit(1)).over(Window.partitionBy("glob", "place")) > 1)


def relocations(dead: DataFrame, old_files: DataFrame, renames: DataFrame, tracked: DataFrame) -> DataFrame:
    """(glob, file_count, linked_count, moved_count, suggested, extra_matches, lowest_similarity) of each dead glob with old files."""
    return settled(links(dead, old_files, renames, tracked), tracked)


def settled(linked: DataFrame, tracked: DataFrame) -> DataFrame:
    """`relocations` from the links of each glob's old files."""
    best = votes(linked).where((F.col("place") == 1) & ~F.col("tied") & (2 * F.col("moved") > F.col("files")))
    best = best.withColumn("candidate", F.when(F.col("s.literal"), F.col("home")).otherwise(F.concat("home", "s.rest"))).where("candidate <> glob")
    hits = globjoin.match(best.select(F.col("candidate").alias("glob")), tracked).withColumnRenamed("glob", "candidate")
    claimed = linked.join(best.select("glob", "candidate", "home", "s"), "glob").where(F.col("new_path").startswith(F.col("home")) & F.col("new_path").isNotNull())
    tail = F.substr(F.col("old_path"), F.length("s.prefix") + 1)
    claimed = claimed.where(F.concat("home", tail) == F.col("new_path")).select("glob", "candidate", F.col("new_path").alias("path"))
    covered = claimed.join(hits.withColumn("hit", F.lit(1)), ["candidate", "path"], "left").groupBy("glob", "candidate").agg(F.count(F.lit(1)).alias("claimed"), F.count("hit").alias("covered"))
    total = hits.groupBy("candidate").agg(F.count(F.lit(1)).alias("total"))
    good = covered.where("claimed = covered").join(total, "candidate").select("glob", F.col("candidate").alias("suggested"), (F.col("total") - F.col("claimed")).cast("int").alias("extra_matches"))
    base = linked.groupBy("glob").agg(F.first("files").alias("file_count"), F.count("new_path").cast("int").alias("linked_count"), F.min("similarity").cast("int").alias("any_lowest"))
    out = base.join(good, "glob", "left").join(best.select("glob", "moved", "lowest"), "glob", "left")
    known = F.col("suggested").isNotNull()
    return out.select(
        "glob", "file_count", "linked_count", F.when(known, F.col("moved")).otherwise(0).alias("moved_count"), "suggested",
        F.coalesce("extra_matches", F.lit(0)).alias("extra_matches"), F.when(known, F.col("lowest")).otherwise(F.col("any_lowest")).alias("lowest_similarity"),
    )


def relocations_at(dead: DataFrame, old_files: DataFrame, renames: DataFrame, tracked: DataFrame) -> DataFrame:
    """`relocations` of dead(glob, rev) over old_files(rev, path) and renames(rev, old_path, ...) of several trees at once; a glob sees those of its own."""
    before = globjoin.match(dead, old_files.select("path").distinct()).join(dead, "glob").join(old_files, ["path", "rev"]).select("glob", "rev", F.col("path").alias("old_path")).distinct()
    sizes = before.groupBy("glob").agg(F.count(F.lit(1)).cast("int").alias("files"))
    alive = renames.join(tracked.select(F.col("path").alias("new_path")), "new_path", "left_semi")
    linked = before.join(alive, ["old_path", "rev"], "left").join(sizes, "glob").select("glob", "old_path", "new_path", "similarity", "files")
    return settled(linked, tracked)
