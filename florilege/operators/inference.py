"""What a document without front matter would say of itself: id, kind, and the files it describes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.sources.tables import stored

# Extensions of source files, verbs that begin a procedure's steps, and how files are mentioned.
CODE = "ts tsx js jsx mjs cjs py go rs rb java kt swift c h cc cpp hpp cs php scala sql proto graphql gql yaml yml toml json tf sh vue svelte".split()
IMPERATIVE = "run|install|deploy|restart|check|open|click|set|export|ssh|kubectl|curl|scale|rollback|verify|stop|start|apply|create|delete"
MENTIONS = (
    r"(?:^|[\s`'\"(\[<])((?:\.{0,2}/)?[\w@.\-]+(?:/[\w@.\-]+)+\.[A-Za-z]{1,6})",
    r"(?:from|import|require\(|include|source)\s*['\"`]([^'\"`]+)['\"`]",
    r"`([\w.\-]+\.[A-Za-z]{1,6})`",
)


def kind(path: Column, body: Column, found: Column) -> Column:
    """Kind by path, headings and the shape of the body; the first rule that applies."""
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    heads = F.transform(found, lambda h: F.trim(F.regexp_replace(F.lower(h["text"]), "[^a-z0-9 ]", "")))

    def has(*names: str) -> Column:
        return F.exists(heads, lambda h: h.rlike(rf"^({'|'.join(names)})( |\z)"))

    steps = F.size(F.filter(F.split(body, "\n"), lambda x: x.rlike(rf"(?i)^\s*(?:\d+[.)]|[-*])\s+(?:{IMPERATIVE})\b")))
    return (
        F.when(low.contains("handoff"), "handoff")
        .when(low.rlike("/(adr|adrs|decisions?)/") | name.rlike(r"^\d{3,4}-"), "decision")
        .when(has("decision", "consequences") & has("context"), "decision")
        .when(name.rlike(r"^(readme|index)\.mdx?\z"), "index")
        .when(low.rlike("runbook|playbook|oncall|on-call|operations|/ops/") | has("runbook", "steps", "procedure", "rollback", "escalation"), "runbook")
        .when(low.rlike("/(spec|specs|rfc|rfcs|design)/") | has("requirements", "non goals", "nongoals", "acceptance criteria", "scope"), "spec")
        .when(low.rlike("reference|/api/|schema|glossary|changelog") | has("api", "reference", "schema", "endpoints", "parameters", "options"), "reference")
        .when(steps >= 4, "runbook")
        .otherwise("guide")
    )


def source_files(files: DataFrame) -> DataFrame:
    ext = F.lower(F.regexp_extract("path", r"\.([^.]*)\z", 1))
    return files.select("path").where(ext.isin(*CODE)).distinct()


def source_index(files: DataFrame) -> DataFrame:
    """(suffix, path, n): each proper suffix of a source file's path, file name included, and how many files share it."""
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    rows = source_files(files).select("path", F.explode(F.when(F.size(parts) > 1, ends).otherwise(F.array("path"))).alias("suffix"))
    return rows.groupBy("suffix").agg(F.min("path").alias("path"), F.count(F.lit(1)).cast("int").alias("n"))


def mentions(docs: DataFrame) -> DataFrame:
    """(path, mention): distinct texts of a body that look like files."""
    found = F.array_distinct(F.concat(*[F.regexp_extract_all("body", F.lit(m), F.lit(1)) for m in MENTIONS]))
    return docs.select("path", F.explode(found).alias("mention"))


def resolve(mentioned: DataFrame, files: DataFrame) -> DataFrame:
    """(path, mention, file): mentions that stand for one source file; others have no row.

    In order: the path itself, the TypeScript source of a .js mention, a suffix that one file has.
    """
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim("mention"), r"^\./", ""), "^/+", ""), r"^(\.\./)+", "")
    rows = mentioned.withColumn("m", clean).where((F.col("m") != "") & ~F.col("m").startswith("http"))
    rows = rows.withColumn("ts", F.regexp_replace(F.regexp_replace("m", r"\.js\z", ".ts"), r"\.jsx\z", ".tsx"))
    # as many rows as files: sorted, never sent to all machines
    exact = source_files(files).hint("merge")
    unique = source_index(files).hint("merge").where("n = 1").select("suffix", F.col("path").alias("only"))
    out = rows.join(exact.select(F.col("path").alias("m"), F.col("path").alias("f1")), "m", "left").join(exact.select(F.col("path").alias("ts"), F.col("path").alias("f2")), "ts", "left")
    out = out.join(unique.toDF("m", "f3"), "m", "left").join(unique.toDF("ts", "f4"), "ts", "left")
    return out.withColumn("file", F.coalesce("f1", "f2", "f3", "f4")).where("file is not null").select("path", "mention", "file")


def describes(resolved: DataFrame, most: int = 6) -> DataFrame:
    """(path, globs, evidence): a folder with three files or more becomes one glob; most-cited folders first."""
    files = resolved.select("path", "file").distinct().withColumn("dir", F.when(F.col("file").contains("/"), F.regexp_replace("file", r"/[^/]*\z", "")).otherwise(F.lit(".")))
    by_dir = files.groupBy("path", "dir").agg(F.array_sort(F.collect_list("file")).alias("own"))
    globs = F.when((F.size("own") >= 3) & (F.col("dir") != "."), F.array(F.concat("dir", F.lit("/**")))).otherwise(F.col("own"))
    # folders cited equally often stand in order of their first file
    one = by_dir.select("path", F.struct((-F.size("own")).alias("n"), F.get("own", F.lit(0)).alias("first"), globs.alias("globs"), "own").alias("d"))
    sorted_ = one.groupBy("path").agg(F.array_sort(F.collect_list("d")).alias("ds"))
    return sorted_.select("path", F.slice(F.flatten(F.transform("ds", lambda d: d["globs"])), 1, most).alias("globs"), F.array_sort(F.flatten(F.transform("ds", lambda d: d["own"]))).alias("evidence"))


def slug(text: Column) -> Column:
    """A folder's or file's name as part of an id."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"\.(?:md|mdx)\z", ""), r"^\d{1,4}[-_]", "")
    return F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def wanted_ids(path: Column) -> Column:
    """The ids a path would take, the best first: its own name, then with its folders' names, the nearest first.

    A document with none of them free takes the last with the least free number from 2 on.
    """
    parts = F.transform(F.split(path, "/"), slug)
    name, folders = F.element_at(parts, -1), F.reverse(F.slice(parts, 1, F.size(parts) - 1))
    parent = F.coalesce(F.get(folders, F.lit(0)), F.lit(""))
    own = F.when(name.isin("", "readme", "index"), F.array_join(F.filter(F.array(parent, name), lambda x: x != ""), "-")).otherwise(name)
    own = F.when(own == "", "doc").otherwise(own)
    longer = lambda ids, folder: F.array_append(ids, F.concat(folder, F.lit("-"), F.element_at(ids, -1)))
    return F.aggregate(F.filter(folders, lambda x: x != ""), F.array(own), longer)


def _numbers(rows: DataFrame) -> DataFrame:
    """rows(path, ids, n) with n raised so that it grows along the paths of each last id.

    Of documents that number the same id, a later path's number is greater than an earlier one's. The
    rows are split by ranges of (id, path); only a row for each range and id meets in a window.
    """
    base = rows.withColumn("base", F.element_at("ids", -1))
    parts = base.repartitionByRange("base", "path").withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("base", "_part").orderBy("path")
    parts = parts.withColumn("_i", F.row_number().over(inside).cast("long"))
    # written, as ranges found a second time might differ
    parts = stored(parts.withColumn("_top", F.max(F.col("n") - F.col("_i")).over(inside)))
    ends = parts.groupBy("base", "_part").agg(F.max("_i").alias("_size"), F.max("_top").alias("_end"))
    before = Window.partitionBy("base").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_from", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    ends = ends.withColumn("_above", F.max(F.col("_end") - F.col("_from")).over(before)).drop("_size", "_end")
    n = F.col("_from") + F.col("_i") + F.greatest(F.coalesce("_above", F.col("_top") - F.col("_from")), F.col("_top") - F.col("_from"))
    return parts.join(ends, ["base", "_part"]).select("path", "ids", "at", n.alias("n"))


def _past_taken(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """rows(path, ids, n) with n beyond a run of taken numbers that it lies in."""
    number = F.regexp_extract("id", r"-([1-9]\d{0,8})\z", 1)
    held = taken.withColumn("n", F.nullif(number, F.lit("")).cast("long")).where("n >= 2")
    held = held.select(F.regexp_replace("id", r"-\d+\z", "").alias("base"), "n").distinct()
    run = F.col("n") - F.row_number().over(Window.partitionBy("base").orderBy("n"))
    runs = held.withColumn("run", run).groupBy("base", "run").agg(F.min("n").alias("low"), F.max("n").alias("high")).drop("run")
    in_run = (F.element_at("ids", -1) == F.col("base")) & F.col("n").between(F.col("low"), F.col("high"))
    return rows.join(runs, in_run, "left").withColumn("n", F.coalesce(F.col("high") + 1, F.col("n"))).select("path", "ids", "at", "n")


def infer_ids(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """(path, id): each document of docs(path) takes, in order of paths, the first of its ids that is free.

    taken(id): ids in use already. Whether an id is free depends on all documents before, but needs no
    single group: in each round every document claims its best id left, of the claims to one id the
    first path keeps it, and the others move on for good. What stands when nobody moves is the serial
    result, as all ids prefer documents by the same order. Rounds are about as many as folders in a
    path: documents that number one id are told apart by sorting, and runs of taken numbers are passed
    at once. Only documents named like a number of another's id (`doc-2.md`) cost a round each, at most.
    Null paths have no row; equal paths count once.
    """
    used = stored(taken.select("id").where("id is not null").distinct())
    start = docs.select("path").where("path is not null").distinct()
    rows = stored(start.select("path", wanted_ids(F.col("path")).alias("ids"), F.lit(0).alias("at"), F.lit(2).cast("long").alias("n")))
    while True:
        at_number = F.col("at") >= F.size("ids")
        claimed = F.when(at_number, F.concat(F.element_at("ids", -1), F.lit("-"), F.col("n").cast("string"))).otherwise(F.get("ids", F.col("at")))
        claims = rows.withColumn("id", claimed)
        first = claims.groupBy("id").agg(F.min("path").alias("first")).join(used.withColumn("used", F.lit(True)), "id", "left")
        judged = stored(claims.join(first, "id").withColumn("lost", F.coalesce("used", F.lit(False)) | (F.col("path") != F.col("first"))))
        if judged.where("lost").isEmpty():
            return judged.select("path", "id")
        moved = judged.select(
            "path", "ids", F.when(F.col("lost") & ~at_number, F.col("at") + 1).otherwise(F.col("at")).alias("at"), F.when(F.col("lost") & at_number, F.col("n") + 1).otherwise(F.col("n")).alias("n")
        )
        numbered = moved.where(at_number)
        rows = stored(moved if numbered.isEmpty() else moved.where(~at_number).unionByName(_past_taken(_numbers(numbered), used)))


def confidence(globs: Column, evidence: Column) -> Column:
    return F.when(F.size(globs) == 0, "low").when(F.size(evidence) >= 3, "high").otherwise("medium")

