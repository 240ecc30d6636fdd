"""Which tracked files a glob matches: equi-joins on a key of the glob, its expression as a residual."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.functions import globs as G
from florilege.sources.tables import stored


def _compiled(glob: pd.Series) -> pd.DataFrame:
    rows = [(G.to_regex(g), *_key(g)) for g in glob.fillna("")]
    return pd.DataFrame(rows, columns=["rx", "kind", "key"])


def _key(glob: str) -> tuple[str, str]:
    kind, value = G.join_key(glob)
    end = G.ending(glob) if kind == "none" else ""
    return ("end", end) if end else (kind, value)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows in as many partitions as the session shuffles into: few bytes may be much work for Python, and would be merged into one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def match(globs: DataFrame, files: DataFrame) -> DataFrame:
    """(glob, path) for each distinct glob of globs(glob) and each file of files(path) that it matches.

    A glob without wildcards meets its path, one with a plain last part the files of that name, one
    with a fixed leading folder the files below it, one that ends in a plain ending the files that end
    so. All others meet the files that hold the rarest three letters of theirs, see `by_grams`. The
    distinct globs with their keys are written first, as each way reads them.
    """
    keyed = spread(globs.select("glob").where("glob is not null and glob <> ''").distinct(), "glob").withColumn("c", F.pandas_udf(_compiled, "rx string, kind string, key string")("glob")).select("glob", "c.rx", "c.kind", "c.key")
    # globs and paths both grow with the input: joined by sorting, never sent to all machines
    keyed = stored(keyed).hint("merge")
    kinds = {r.kind for r in keyed.select("kind").distinct().collect()}  # five at most
    paths = files.select("path").distinct()
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    by = {
        "path": paths.withColumn("key", F.col("path")),
        "name": paths.withColumn("key", F.element_at(parts, -1)),
        # the folder itself may be listed, as `x/**` stands for x too
        "folder": paths.withColumn("key", F.explode(F.array_distinct(F.concat(folders, F.array("path"))))),
        "end": paths.withColumn("key", F.regexp_extract("path", r"\.([^./]+)\z", 1)).where("key <> ''"),
    }
    found = None
    for kind, side in by.items():
        if kind not in kinds:
            continue
        part = keyed.where(F.col("kind") == kind).join(side, "key").where(F.regexp_like("path", F.col("rx")))
        part = part.select("glob", "path")
        found = part if found is None else found.unionByName(part)
    if "none" not in kinds:
        return paths.sparkSession.createDataFrame([], "glob string, path string") if found is None else found.distinct()
    loose = keyed.where("kind = 'none'").select("glob", "rx", F.explode(F.pandas_udf(_grams, "array<array<string>>")("glob")).alias("grams"))
    met = by_grams(loose, paths)
    return met if found is None else found.unionByName(met).distinct()


def _grams(glob: pd.Series) -> pd.Series:
    return glob.map(G.gram_keys)


def by_grams(globs: DataFrame, paths: DataFrame) -> DataFrame:
    """(glob, path) of globs(glob, rx, grams) and paths(path) where rx matches; a path that matches holds all the grams as `/path/`.

    Each row of globs meets the paths that hold its rarest gram, by how many paths hold each. Only grams
    that some glob has leave the scan of the paths. Rows without grams, such as those of `**` and `*/*`,
    have no letter to be found by; they match most paths of a depth and are compared with all.
    """
    rows = globs.distinct()
    lettered = rows.where(F.size("grams") > 0)
    wanted = lettered.select(F.explode("grams").alias("gram")).distinct()
    closed = F.concat(F.lit("/"), "path", F.lit("/"))
    parts = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(closed) - (n - 1), F.lit(1))), lambda i: F.substr(closed, i, F.lit(n)))
    held = paths.select("path", F.explode(F.array_distinct(F.concat(parts(1), parts(2), parts(3)))).alias("gram")).join(wanted, "gram", "left_semi")
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a gram that no path holds is the rarest: its globs match nothing
    each = lettered.select("glob", "rx", "grams", F.explode("grams").alias("gram")).join(counts, "gram", "left")
    rarest = each.groupBy("glob", "rx", "grams").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least")).where("least.n > 0")
    keyed = rarest.select("glob", "rx", F.col("least.gram").alias("gram")).join(held, "gram")
    bare = paths.join(rows.where(F.size("grams") == 0), F.regexp_like("path", F.col("rx")))
    return keyed.where(F.regexp_like("path", F.col("rx"))).select("glob", "path").unionByName(bare.select("glob", "path")).distinct()


def resolve(doc_globs: DataFrame, files: DataFrame) -> DataFrame:
    """(path, glob, file) of doc_globs(path, glob): every file that a document describes."""
    hits = match(doc_globs, files).withColumnRenamed("path", "file")
    return doc_globs.select("path", "glob").join(hits.hint("merge"), "glob").select("path", "glob", "file")


def missing(doc_globs: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of doc_globs whose glob matches no file."""
    return doc_globs.join(match(doc_globs, files).select("glob").distinct().hint("merge"), "glob", "left_anti")


def folder_claims(globs: DataFrame, files: DataFrame, hits: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """(glob, path) of globs without wildcards that match no file but name a folder of files, or a path of present(path).

    hits: what `match` found. A claim on a folder stands for the folder as one path.
    """
    plain = globs.select("glob").where("glob is not null and glob <> ''").distinct().join(hits.select("glob").distinct(), "glob", "left_anti").withColumn("path", G.literal(F.col("glob"))).where("path is not null")
    parts = F.split("path", "/")
    above = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("folder"), "path").where("folder <> path")
    known = above.select(F.col("folder").alias("path")).distinct()
    known = known if present is None else known.union(present.select("path")).distinct()
    return plain.join(known, "path").select("glob", "path")


def below(folders: DataFrame, touched: DataFrame) -> DataFrame:
    """(folder, path) of the paths of touched(path) that lie below each folder of folders(folder)."""
    parts = F.split("path", "/")
    above = touched.select("path").distinct().withColumn("folder", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")))).where("folder <> path")
    return above.join(folders.select("folder").distinct(), "folder").select("folder", "path")
