"""A repository's history as a Spark data source: `spark.read.format("git_log").load(root)`.

Options: `table` (commits, commit_files, files, trees, renames), `head` (the revision to read, HEAD by
default, fixed once when the read is planned), `commits` (of one partition), `revs` (revisions of trees
and renames, separated by commas).

Commits are read in partitions by ranges of the log, each by a git process of the task that holds it,
which ends with its range; rows leave as Arrow batches, so that neither the driver nor a task holds the
history. A schema given to the reader prunes columns: git is asked for the fields of that schema alone,
and compares trees only where files are read. trees and renames have one partition a revision. The
repository must lie at the same path on all machines.

Defined cases: a folder without commits gives no rows; a process that fails fails the read, so a part of
a history never stands for all of it; a merge shows no files of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from florilege.sources import history as H

COMMITS = "sha string, author_ts timestamp, commit_ts timestamp, subject string, author string"
FILES = "sha string, path string, change_type string"
TABLES = {
    "commits": f"{COMMITS}, seq long",
    "commit_files": FILES,
    "files": "path string",
    "trees": "rev string, path string",
    "renames": "rev string, old_path string, new_path string, similarity int",
}
PLACES = {"sha": "%H", "author_ts": "%at", "commit_ts": "%ct", "subject": "%s", "author": "%an"}
STEP = 20_000
BATCH_ROWS = 10_000


@dataclass
class Range(InputPartition):
    """Some commits of the log of `rev`, or all that a revision holds."""

    rev: str
    skip: int = 0
    count: int = 0


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_log"

    def _table(self) -> str:
        table = self.options.get("table", "commits")
        if table not in TABLES:
            raise ValueError(f"table must be one of {', '.join(TABLES)}")
        return table

    def schema(self) -> str:
        return TABLES[self._table()]

    def reader(self, schema: StructType) -> GitLogReader:
        known = {c.split()[0] for c in TABLES[self._table()].split(", ")}
        if unknown := [f.name for f in schema if f.name not in known]:
            raise ValueError(f"{self._table()} has no column {', '.join(unknown)}")
        return GitLogReader(self._table(), dict(self.options), schema)


class GitLogReader(DataSourceReader):
    def __init__(self, table: str, options: dict, schema: StructType) -> None:
        self.table, self.root, self.schema = table, options["path"], schema
        self.head, self.step, self.revs = options.get("head", "HEAD"), int(options.get("commits", STEP)), [r for r in options.get("revs", "").split(",") if r]

    def partitions(self) -> list[Range]:
        if self.table in ("trees", "renames"):
            return [Range(r) for r in self.revs] or [Range("")]
        if self.table == "files":
            return [Range("HEAD" if H.is_repo(self.root) else "")]
        head = (H.git(self.root, "rev-parse", "--verify", "-q", self.head) or "").strip()
        count = int("".join(H.stream(self.root, b"\n", "rev-list", "--count", head))) if head else 0
        return [Range(head, at, min(self.step, count - at)) for at in range(0, count, self.step)] or [Range("")]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(self.schema)
        rows = []
        for row in getattr(self, f"_{self.table}")(part) if part.rev else ():
            rows.append(row)
            if len(rows) == BATCH_ROWS:
                yield self._batch(rows, kinds)
                rows = []
        if rows:
            yield self._batch(rows, kinds)

    @staticmethod
    def _batch(rows: list[dict], kinds: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in kinds], schema=kinds)

    def _log(self, part: Range, fields: list[str], *more: str) -> Iterator[list[str]]:
        """The fields of each commit of a range, and what follows them."""
        form = "--format=%x1e" + "".join(f"{PLACES[f]}%x1f" for f in fields)
        for record in H.stream(self.root, b"\x1e", "log", "--date-order", f"--skip={part.skip}", f"--max-count={part.count}", "-z", form, *more, part.rev, "--"):
            if record:
                yield record.split("\x1f", len(fields))

    def _commits(self, part: Range) -> Iterator[dict]:
        names = [f.name for f in self.schema if f.name in PLACES]
        for seq, found in enumerate(self._log(part, names), part.skip):
            row = dict(zip(names, found, strict=False)) | {"seq": seq}
            for when in ("author_ts", "commit_ts"):
                if when in row:
                    row[when] = datetime.fromtimestamp(int(row[when]), UTC)
            yield row

    def _commit_files(self, part: Range) -> Iterator[dict]:
        for sha, names in self._log(part, ["sha"], "--no-renames", "--name-status"):
            parts = [x for x in (x.lstrip("\n") for x in names.split("\0")) if x]
            for status, path in zip(parts[::2], parts[1::2], strict=False):
                yield {"sha": sha, "path": path, "change_type": status[:1]}

    def _files(self, part: Range) -> Iterator[dict]:
        last = None
        for path in H.stream(self.root, b"\0", "ls-files", "-z"):  # in order; a path in conflict stands several times
            if path and path != last:
                yield {"path": path}
            last = path

    def _trees(self, part: Range) -> Iterator[dict]:
        for path in H.stream(self.root, b"\0", "ls-tree", "-r", "-z", "--name-only", part.rev):
            if path:
                yield {"rev": part.rev, "path": path}

    def _renames(self, part: Range) -> Iterator[dict]:
        """Between the tree of a revision and the working one, as git sees it."""
        words = H.stream(self.root, b"\0", "diff", "-M", f"-l{H.RENAMES}", "--name-status", "-z", part.rev, "--")
        for status in words:
            if not status:
                continue
            old = next(words)
            if status[0] in ("R", "C"):
                new = next(words)
                if status[0] == "R":
                    yield {"rev": part.rev, "old_path": old, "new_path": new, "similarity": int(status[1:] or 0)}


def read(spark: SparkSession, root: str, table: str, schema: str | None = None, **options: str) -> DataFrame:
    """A table of the repository at root."""
    spark.dataSource.register(GitLog)
    reader = spark.read.format("git_log").option("table", table).options(**options)
    return (reader.schema(schema) if schema else reader).load(root)


def tracked_files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the files under version control; none outside a repository."""
    return read(spark, root, "files")


def history(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(commits, commit_files) of a repository, read by tasks when asked for; empty where there is no commit. A log that cannot be walked is an error at once."""
    if H.has_commits(root):
        for _ in H.stream(root, b"\n", "rev-list", "--count", "HEAD"):
            pass
    return read(spark, root, "commits", COMMITS), read(spark, root, "commit_files")


def renames(spark: SparkSession, root: str, revs: list[str]) -> DataFrame:
    """(rev, old_path, new_path, similarity) between the tree of each revision and the working one, as git sees it."""
    return read(spark, root, "renames", revs=",".join(revs))


def trees(spark: SparkSession, root: str, revs: list[str]) -> DataFrame:
    """(rev, path) of the trees of several revisions."""
    return read(spark, root, "trees", revs=",".join(revs))
