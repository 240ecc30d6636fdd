"""Markdown files as a table of documents."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.dims import Config
from florilege.functions import frontmatter as FM
from florilege.functions import globs as G
from florilege.functions import text as T
from florilege.sources.tables import stored

MOST_BYTES = 2 << 20
BATCH_BYTES = 16 << 20
FOLDERS_A_TASK = 64
MOST_DEPTH = 32
NEVER = frozenset((".git", "node_modules"))


def listing(root: str, config: Config | None = None) -> list[str]:
    """Paths below root, sorted, that the configuration includes, found by one process; see `walk`."""
    look, out, open_ = _looker(root, config or Config(), os.scandir), [], [("", 0)]
    while open_:
        folder, depth = open_.pop()
        for path, inner in look(folder, depth):
            if inner is None:
                out.append(path)
            else:
                open_.append((path, inner))
    return sorted(out)


def _looker(root: str, config: Config, scan: Callable) -> Callable[[str, int], Iterator[tuple[str, int | None]]]:
    """What one folder shows: (path, depth) of each folder to enter, (path, None) of each file wanted."""

    def shut(path: str) -> bool:
        return G.matches_any(config.exclude, path) or G.matches_any(config.exclude, f"{path}/__any__")

    def look(folder: str, depth: int) -> Iterator[tuple[str, int | None]]:
        try:
            entries = list(scan(os.path.join(root, folder)))
        except OSError:
            return
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            if e.is_symlink():
                continue
            if e.is_dir():
                if depth < MOST_DEPTH and e.name not in NEVER and not shut(path):
                    yield path, depth + 1
            elif G.matches_any(config.include, path) and not G.matches_any(config.exclude, path):
                yield path, None

    return look


def walk(spark: SparkSession, root: str, config: Config | None = None, scan: Callable = os.scandir) -> DataFrame:
    """(path) of every file below root that the configuration includes; the same paths as `listing`.

    One round of tasks for each level of folders: a task opens the folders of its share, and only folders
    that no pattern excludes are in the next round, so excluded ones are never opened and links never
    followed. Each round is written in the shared folder; the driver holds only how many folders are
    open. Root must be visible to all machines. Folders that cannot be read have no files.
    """
    root, config = os.path.abspath(root), config or Config()

    def open_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = _looker(root, config, scan)
        for frame in frames:
            for folder in frame["path"]:
                found = pd.DataFrame(list(look(folder, folder.count("/") + 1 if folder else 0)), columns=["path", "depth"])
                yield pd.DataFrame({"path": found["path"].astype(object), "is_dir": found["depth"].notna()})

    rounds, open_, n = [], spark.createDataFrame([("",)], "path string"), 1
    while n:
        shares = open_.repartition(min(-(-n // FOLDERS_A_TASK), 8 * spark.sparkContext.defaultParallelism), "path")
        found = stored(shares.mapInPandas(open_all, "path string, is_dir boolean"))
        rounds.append(found.where("not is_dir").select("path"))
        open_ = found.where("is_dir").select("path")
        n = open_.count()
    return reduce(DataFrame.union, rounds)


def contents(paths: DataFrame, root: str) -> DataFrame:
    """(path, content) of the files of paths(path), read where the rows lie in batches of bounded size.

    Files over MOST_BYTES are left unread; a file that went since the walk has no row.
    """
    root = os.path.abspath(root)

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            for path in frame["path"]:
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        content = f.read(MOST_BYTES + 1)
                except OSError:
                    continue
                if len(content) > MOST_BYTES:
                    continue
                held.append((path, content))
                size += len(content)
                if size >= BATCH_BYTES:
                    yield pd.DataFrame(held, columns=["path", "content"])
                    held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=["path", "content"])

    return paths.mapInPandas(fetch, "path string, content binary")


def present(globs: DataFrame, root: str) -> DataFrame:
    """(path) of the plain paths among globs(glob) that lie below root on disk, tracked or not; tasks look them up."""
    root = os.path.abspath(root)

    def there(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[os.path.exists(os.path.join(root, p)) for p in frame["path"]]]

    plain = globs.select(G.literal(F.col("glob")).alias("path")).where("path is not null").distinct()
    return plain.mapInPandas(there, "path string")


def read(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    """One row a document: path, raw, front matter, body, headings, title, word_count, token_estimate, content_hash."""
    files = contents(walk(spark, root, config).repartition("path"), root)
    plain = files.where(F.instr(F.decode(F.substring("content", 1, 8192), "ISO-8859-1"), "\0") == 0)
    return describe(plain.select("path", F.decode("content", "UTF-8").alias("raw")))


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All markdown files of a folder that only Spark may read, without pruning."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,mdx}").load(folder)
    return describe(files.where(F.col("length") <= MOST_BYTES).select("path", F.decode("content", "UTF-8").alias("raw")))


def describe(raw: DataFrame) -> DataFrame:
    """Adds all that a document says of itself to raw(path, raw)."""
    split = FM.fields(FM.split(raw))
    usable = "struct<spec:double,id:string,kind:string,describes:array<string>,verify:string,owner:string,expires:string,ttlDays:int,supersedes:array<string>,tags:array<string>,pin:boolean>"
    docs = split.withColumn("fm", F.from_json("usable", usable)).withColumn("headings", T.headings(F.col("body")))
    return docs.select(
        "path", "raw", "has_fm", "errors", "warnings", "body", F.col("fm.id").alias("id"), F.col("fm.kind").alias("kind"), F.col("fm.verify").alias("verify"), F.col("fm.owner").alias("owner"),
        F.coalesce("fm.describes", F.array().cast("array<string>")).alias("claims"), F.try_to_timestamp("fm.expires").alias("expires"), F.col("fm.ttlDays").alias("ttl_days"),
        F.coalesce("fm.supersedes", F.array().cast("array<string>")).alias("supersedes"), F.coalesce("fm.tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("fm.pin", F.lit(False)).alias("pin"),
        T.doc_title(F.col("path"), F.col("headings")).alias("title"), F.transform("headings", lambda h: h["text"]).alias("headings"),
        T.word_count(F.col("body")).alias("word_count"), T.token_estimate(F.col("body")).alias("token_estimate"), T.content_hash(F.col("body")).alias("content_hash"),
    )


def doc_globs(docs: DataFrame) -> DataFrame:
    """(path, ord, glob) of docs(path, claims)."""
    return docs.select("path", F.posexplode("claims").alias("ord", "glob")).where(F.trim("glob") != "")
