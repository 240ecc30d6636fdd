"""Documents against history: what each describes, when it moved, and the verdict that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.dims import VERDICTS, Config, lookup, severity, verdict_of
from florilege.functions import text as T
from florilege.operators import globjoin
from florilege.sources.tables import stored

MOST_FILES = 20


def whole_days(a: Column, b: Column) -> Column:
    return F.floor((F.unix_millis(b) - F.unix_millis(a)) / 86_400_000).cast("int")


def drift_score(days: Column, commits: Column, config: Config) -> Column:
    share = F.greatest(F.lit(0), days) / float(max(1, config.stale_drift_days)) + F.greatest(F.lit(0), commits) / float(max(1, config.stale_commit_count))
    return 100.0 * F.pow(F.lit(0.5), share)


def decay(verdict: str, days: Column, half_life: int) -> Column:
    low, high = VERDICTS[verdict][2]
    return low + (high - low) * F.pow(F.lit(0.5), F.greatest(F.lit(0), days) / float(half_life))


def ladder(days: Column, commits: Column, config: Config) -> Column:
    return (
        F.when((days >= config.stale_drift_days) | (commits >= config.stale_commit_count), F.lit("stale"))
        .when((days >= config.warn_drift_days) | (commits >= config.warn_commit_count), F.lit("drifting"))
        .otherwise(F.lit("fresh"))
    )


def banded(score: Column, verdict: Column) -> Column:
    bands = {k: v[2] for k, v in VERDICTS.items()}
    out = None
    for k, (low, high) in bands.items():
        one = F.least(F.greatest(score, F.lit(float(low))), F.lit(float(high)))
        out = F.when(verdict == k, one) if out is None else out.when(verdict == k, one)
    return out


def newest(history: DataFrame, key: str) -> DataFrame:
    """(key, commit) with the newest commit of each key; ties go to the greater sha."""
    commit = F.struct(F.col("author_ts").alias("ts"), "sha", "subject")
    return history.groupBy(key).agg(F.max(commit).alias("commit"))


def doc_last_commit(docs: DataFrame, commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """(path, commit): each document's own newest commit, where it has one."""
    own = commit_files.join(docs.select("path"), "path", "left_semi")
    return newest(own.join(commits, "sha"), "path")


def file_history(resolved: DataFrame, commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """(path, file, sha, author_ts, commit_ts, subject): commits to the files each document describes."""
    pairs = resolved.select("path", "file").distinct()
    return pairs.join(commit_files.withColumnRenamed("path", "file"), "file").join(commits, "sha")


def code_last_commit(resolved: DataFrame, commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    return newest(file_history(resolved, commits, commit_files), "path")


def commits_since(resolved: DataFrame, doc_commits: DataFrame, commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """(path, commits_since, changed_files): commits a second or more after the document's own newest one."""
    since = file_history(resolved, commits, commit_files).join(doc_commits.select("path", F.col("commit.ts").alias("doc_ts")), "path")
    later = since.where(F.col("commit_ts") >= F.col("doc_ts") + F.expr("INTERVAL 1 SECOND"))
    return later.groupBy("path").agg(F.countDistinct("sha").cast("int").alias("commits_since"), F.array_sort(F.collect_set("file")).alias("changed"))


def superseded(docs: DataFrame) -> DataFrame:
    """(id, superseded_by) for every id that a document says it replaces."""
    claims = docs.select(F.col("path").alias("by"), F.explode("supersedes").alias("id"))
    return claims.groupBy("id").agg(F.array_sort(F.collect_list("by")).alias("superseded_by"))


def without_history(docs: DataFrame, doc_globs: DataFrame) -> DataFrame:
    """What `assess` gives where there is no version control: every document unverified at 50, whatever it claims."""
    claims = doc_globs.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "glob"))), lambda g: g["glob"]).alias("describes"))
    none, commit, number = F.array().cast("array<string>"), F.lit(None).cast("struct<ts:timestamp,sha:string,subject:string>"), F.lit(0)
    empty = {"doc_commit": commit, "code_commit": commit, "missing": none, "matched": number, "superseded_by": F.lit(None).cast("array<string>"), "age_days": number, "drift_days": number, "commits_since": number, "changed": none}
    level, score = VERDICTS["unverified"][0], VERDICTS["unverified"][2][1]
    fired = F.array(F.struct(F.lit(level).alias("level"), F.lit(float(score)).alias("score")))
    found = docs.join(claims, "path", "left").withColumns({"describes": F.coalesce("describes", none), **empty})
    return found.withColumns({"fired": fired, "freshness": F.lit("unverified"), "score": F.lit(score)})


def assess(
    docs: DataFrame, doc_globs: DataFrame, files: DataFrame, commits: DataFrame, commit_files: DataFrame, now: Column, config: Config | None = None, present: DataFrame | None = None
) -> DataFrame:
    """docs with freshness, score, and the evidence: doc and code commits, drift_days, commits_since, changed, matched, missing, superseded_by, fired.

    docs(path, id, expires timestamp, ttl_days, supersedes array<string>, ...); doc_globs(path, ord,
    glob). The worst verdict that applies names the result, the lowest score of all stands. Evidence
    is gathered per document in three aggregates over the history of described files only. A claim on
    a folder, or on a path of present(path) that is not tracked, counts as one match; a folder's
    history is that of all below it.
    """
    config = config or Config()
    # written once: the branches below read them again and again; as they grow with the documents, they are joined by sorting
    doc_globs = stored(doc_globs.select("path", "ord", "glob")).hint("merge")
    hits = stored(globjoin.match(doc_globs, files)).hint("merge")
    folders = stored(globjoin.folder_claims(doc_globs, files, hits, present)).hint("merge")
    hits = hits.union(folders).hint("merge")
    resolved = doc_globs.select("path", "glob").join(hits.withColumnRenamed("path", "file"), "glob")
    claims = doc_globs.join(hits.select("glob").distinct().withColumn("alive", F.lit(True)), "glob", "left")
    claims = claims.groupBy("path").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "glob"))), lambda g: g["glob"]).alias("describes"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("alive").isNull(), F.struct("ord", "glob")))), lambda g: g["glob"]).alias("missing"),
    )
    matched = resolved.groupBy("path").agg(F.countDistinct("file").cast("int").alias("matched"))
    described = resolved.select("path", "file")
    if not folders.isEmpty():
        inside = globjoin.below(folders.select(F.col("path").alias("folder")), commit_files)
        moved = resolved.join(inside.select(F.col("folder").alias("file"), F.col("path").alias("moved")), "file").select("path", F.col("moved").alias("file"))
        described = stored(described.union(moved)).hint("merge")
    # the history of documents and of what they describe, a part of all, written once for both, with its commits
    asked = docs.select("path").union(described.select("file")).distinct()
    dates = commits.select("sha", "author_ts", "commit_ts", "subject")
    touched = stored(commit_files.select("sha", "path").join(asked.hint("merge"), "path", "left_semi").join(dates, "sha")).hint("merge")
    own = stored(newest(touched.join(docs.select("path"), "path", "left_semi"), "path").withColumnRenamed("commit", "doc_commit")).hint("merge")
    pairs = described.select("path", "file").distinct()
    history = pairs.join(touched.withColumnRenamed("path", "file"), "file").join(own, "path", "left")
    commit = F.struct(F.col("author_ts").alias("ts"), "sha", "subject")
    after = F.col("commit_ts") >= F.col("doc_commit.ts") + F.expr("INTERVAL 1 SECOND")
    code = history.groupBy("path").agg(
        F.max(commit).alias("code_commit"), F.countDistinct(F.when(after, F.col("sha"))).cast("int").alias("since"), F.array_sort(F.collect_set(F.when(after, F.col("file")))).alias("moved")
    )
    # every path with claims has one row; written, so that reports read it and do not make it again
    evidence = stored(claims.join(matched, "path", "left").join(code, "path", "left")).hint("merge")
    all_ = docs.join(own, "path", "left").join(evidence, "path", "left")
    by = superseded(docs).withColumnRenamed("id", "old_id")
    all_ = all_.join(by, F.col("id") == F.col("old_id"), "left").drop("old_id")
    return verdicts(all_, now, config)


def verdicts(e: DataFrame, now: Column, config: Config) -> DataFrame:
    """The verdict of each row of evidence; no shuffle."""
    doc_ts, code_ts = F.col("doc_commit.ts"), F.col("code_commit.ts")
    none = F.lit(None).cast("array<string>")
    e = e.withColumns(
        {
            "describes": F.coalesce("describes", F.array().cast("array<string>")),
            "missing": F.coalesce("missing", F.array().cast("array<string>")),
            "matched": F.coalesce("matched", F.lit(0)),
            "age_days": F.when(doc_ts.isNull(), 0).otherwise(F.greatest(F.lit(0), whole_days(doc_ts, now))),
        }
    )
    claims, measured = F.size("describes") > 0, (F.col("matched") > 0) & doc_ts.isNotNull()
    leads = F.coalesce(code_ts > doc_ts, F.lit(False))
    e = e.withColumns(
        {
            "drift_days": F.when(measured & code_ts.isNotNull(), whole_days(doc_ts, code_ts)).otherwise(0),
            "commits_since": F.when(measured & leads, F.coalesce("since", F.lit(0))).otherwise(0),
            "changed": F.when(measured & leads, F.coalesce(F.slice("moved", 1, MOST_FILES), none)).otherwise(F.array().cast("array<string>")),
        }
    ).drop("since", "moved")
    rung = ladder(F.col("drift_days"), F.col("commits_since"), config)
    quiet = 1 - 0.5 * F.size("missing") / F.greatest(F.size("describes"), F.lit(1))
    kept = banded(drift_score(F.col("drift_days"), F.col("commits_since"), config), rung) * F.when(F.size("missing") > 0, quiet).otherwise(1.0)
    fired = F.array_compact(
        F.array(
            _fired(F.size("superseded_by") > 0, "superseded", decay("superseded", F.col("age_days"), 90)),
            _fired(F.col("expires") <= now, "expired", decay("expired", whole_days(F.col("expires"), now), 30)),
            _fired((F.col("ttl_days") > 0) & doc_ts.isNotNull() & (F.col("age_days") > F.col("ttl_days")), "expired", decay("expired", F.col("age_days") - F.col("ttl_days"), 30)),
            _fired(~claims | ((F.col("matched") > 0) & doc_ts.isNull()), "unverified", F.lit(50.0)),
            _fired(claims & (F.col("matched") == 0), "orphaned", decay("orphaned", F.col("age_days"), 90)),
            F.when(claims & measured, F.struct(severity(rung).alias("level"), kept.alias("score"))),
        )
    )
    e = e.withColumn("fired", fired)
    worst = F.array_max(F.transform("fired", lambda x: x["level"]))
    lowest = F.array_min(F.transform("fired", lambda x: x["score"]))
    score = F.least(F.lit(100), F.greatest(F.lit(0), F.floor(lowest + 0.5))).cast("int")
    return e.withColumn("freshness", verdict_of(worst)).withColumn("score", score)


def _fired(condition: Column, verdict: str, score: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(VERDICTS[verdict][0]).alias("level"), score.cast("double").alias("score")))


def expired(docs: DataFrame, own: DataFrame, now: Column) -> DataFrame:
    """(path, by_date, by_ttl) of documents past their date or their time to live."""
    aged = docs.join(own, "path", "left").withColumn("age", F.greatest(F.lit(0), whole_days(F.col("commit.ts"), now)))
    flags = aged.select("path", F.coalesce(F.col("expires") <= now, F.lit(False)).alias("by_date"), F.coalesce((F.col("ttl_days") > 0) & (F.col("age") > F.col("ttl_days")), F.lit(False)).alias("by_ttl"))
    return flags.where("by_date or by_ttl")


def commit_phrase(commit: Column, now: Column) -> Column:
    subject = F.when(F.length(commit["subject"]) > 72, F.concat(F.left(commit["subject"], F.lit(69)), F.lit("..."))).otherwise(commit["subject"])
    return F.concat(F.left(commit["sha"], F.lit(7)), F.lit(" '"), subject, F.lit("', "), T.ago(whole_days(commit["ts"], now)))


def reason(reports: DataFrame, now: Column, config: Config) -> Column:
    """One sentence for the verdict, naming its evidence."""
    n, days = F.col("commits_since"), F.col("drift_days")
    text = lambda x: x.cast("string")
    globs = T.join_sample(F.col("describes"))
    parts = F.array_compact(
        F.array(
            F.when(n > 0, F.concat(text(n), F.lit(" "), T.plural(n, "commit"), F.lit(" touched "), globs, F.lit(" since (latest: "), commit_phrase(F.col("code_commit"), now), F.lit(")"))),
            F.when(days > 0, F.concat(F.lit("code is "), text(days), F.lit(" "), T.plural(days, "day"), F.lit(" ahead (doc: "), commit_phrase(F.col("doc_commit"), now), F.lit(")"))),
        )
    )
    moved = F.when(F.size(parts) == 0, F.lit("code moved after the doc")).otherwise(F.array_join(parts, "; "))
    return (
        F.when(F.col("freshness") == "superseded", F.concat(F.lit("superseded: replaced by "), T.join_sample(F.col("superseded_by"))))
        .when(F.col("freshness") == "orphaned", F.concat(F.lit("orphaned: "), globs, F.lit(" "), T.plural(F.size("describes"), "matches", "match"), F.lit(" no tracked file")))
        .when(F.col("freshness") == "expired", F.lit("expired: past its date or time to live"))
        .when(F.col("freshness") == "unverified", F.when(F.size("describes") == 0, F.lit("unverified: describes nothing that could be checked")).otherwise(F.concat(F.lit("unverified: "), text(F.col("matched")), F.lit(" "), T.plural(F.col("matched"), "file"), F.lit(" but no history of its own"))))
        .when(F.col("freshness") == "fresh", F.concat(F.lit("fresh: within thresholds for "), text(F.col("matched")), F.lit(" "), T.plural(F.col("matched"), "file"), F.lit(" of "), globs))
        .otherwise(F.concat(F.col("freshness"), F.lit(": "), moved))
    )


MEANING = {
    "fresh": "the code it describes has not moved since it was written",
    "unverified": "it describes nothing that history could check",
    "drifting": "the code it describes has begun to move on; check details",
    "stale": "the code it describes has moved on; do not rely on details",
    "expired": "past the date or the time to live that its author gave it",
    "orphaned": "what it describes is not there any more",
    "superseded": "another document says that it replaces this one",
}


def meaning(verdict: Column) -> Column:
    return lookup(verdict, MEANING)


def evidence_line(reports: DataFrame) -> Column:
    """What history shows of a document, in one line."""
    text = lambda x: x.cast("string")
    day = lambda c: F.concat(F.left(F.col(f"{c}.sha"), F.lit(7)), F.lit(" on "), F.date_format(F.col(f"{c}.ts"), "yyyy-MM-dd"))
    parts = F.array_compact(
        F.array(
            F.when(F.col("doc_commit").isNotNull(), F.concat(F.lit("written "), day("doc_commit"))).otherwise(F.lit("never committed")),
            F.when(F.col("code_commit").isNotNull(), F.concat(F.lit("code moved "), day("code_commit"))).otherwise(F.lit("code without history")),
            F.concat(F.lit("drift "), text(F.col("drift_days")), F.lit("d, "), text(F.col("commits_since")), F.lit(" "), T.plural(F.col("commits_since"), "commit")),
            F.concat(text(F.col("matched")), F.lit(" "), T.plural(F.col("matched"), "file")),
            F.when(F.size("missing") > 0, F.concat(F.lit("nothing at "), F.array_join("missing", ", "))),
        )
    )
    return F.when(F.size("describes") == 0, F.lit("no evidence: it describes nothing")).otherwise(F.array_join(parts, "; "))


def evidence_table(reports: DataFrame, most: int = 10) -> DataFrame:
    """(place, path, freshness, score, evidence): all reports, worst first; the `most` worst that fail show their evidence."""
    bad = ~F.col("freshness").isin("fresh", "unverified")
    rows = reports.select("path", "freshness", "score", F.when(bad, evidence_line(reports)).alias("evidence"))
    order = [severity(F.col("freshness")).desc(), F.col("score").asc(), F.col("path").asc()]
    worst = rows.orderBy(*order).limit(most).select("path", F.lit(True).alias("shown"))
    shown = rows.join(F.broadcast(worst), "path", "left")  # `most` rows
    return shown.select("path", "freshness", "score", F.when(F.col("shown"), F.col("evidence")).alias("evidence"))


def relocation_reason(moves: DataFrame, now: Column | None = None) -> Column:
    """What history shows of a dead glob, and how far that carries, in a few sentences.

    moves: rows of `relocation.relocations`, with `left_in` (commit struct) where the move is committed.
    """
    text = lambda c: F.col(c).cast("string")
    n, linked, moved = F.col("file_count"), F.col("linked_count"), F.col("moved_count")
    files = lambda c: F.concat(c.cast("string"), F.lit(" "), T.plural(c, "file"))
    left = F.lit("the move is not committed yet")
    if "left_in" in moves.columns:
        left = F.when(F.col("left_in").isNull(), left).otherwise(F.concat(F.lit("the last of them left in "), commit_phrase(F.col("left_in"), now)))
    used = F.concat(F.lit("`"), F.col("glob"), F.lit("` matches nothing now but once matched "), files(n), F.lit(" ("), left, F.lit(")."))
    gone = F.when(linked == 0, F.lit(" None of them is linked to a file of today; they were deleted, or rewritten beyond recognition.")).otherwise(
        F.concat(F.lit(" Only "), text("linked_count"), F.lit(" of them "), T.plural(linked, "is", "are"), F.lit(" linked to files of today, too few to name a new home."))
    )
    alike = F.when(F.col("lowest_similarity").isNull(), F.lit("")).otherwise(F.concat(F.lit(" (least alike: "), text("lowest_similarity"), F.lit("%)")))
    rest = F.when(n > moved, F.concat(F.lit(" "), files(n - moved), F.lit(" could not be linked."))).otherwise(F.lit(""))
    extra = F.when(F.col("extra_matches") > 0, F.concat(F.lit(" The new pattern also matches "), files(F.col("extra_matches")), F.lit(" that did not move there."))).otherwise(F.lit(""))
    home = F.concat(F.lit(" "), text("moved_count"), F.lit(" of "), files(n), F.lit(" now "), T.plural(moved, "stands", "stand"), F.lit(" at `"), F.col("suggested"), F.lit("`"), alike, F.lit("."), rest, extra)
    return F.concat(used, F.when(F.col("suggested").isNull(), F.concat(gone, F.lit(" No new pattern is suggested."))).otherwise(home))


def with_moves(reports: DataFrame, moves: DataFrame) -> DataFrame:
    """Adds `moves`: (glob, suggested) of each document's dead globs that have a new home."""
    known = moves.where("suggested is not null").select("glob", "suggested")
    dead = reports.select("path", F.explode("missing").alias("glob")).join(known, "glob")
    per = dead.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("glob", "suggested"))).alias("moves"))
    return reports.join(per, "path", "left").withColumn("moves", F.coalesce("moves", F.array().cast("array<struct<glob:string,suggested:string>>")))


def fix_hint(reports: DataFrame) -> Column:
    """The next step that would clear a verdict; with a column `moves`, where an orphan's code has gone."""
    n = F.col("commits_since")
    if "moves" in reports.columns:
        swaps = F.array_join(F.transform("moves", lambda m: F.concat(F.lit("`"), m["glob"], F.lit("` to `"), m["suggested"], F.lit("`"))), ", ")
        plain = fix_hint(reports.drop("moves"))
        return F.when((F.col("freshness") == "orphaned") & (F.size("moves") > 0), F.concat(F.lit("the code moved: change `describes` from "), swaps, F.lit(" and read the doc against it"))).otherwise(plain)
    return (
        F.when(F.col("freshness") == "unverified", F.concat(F.lit("name the source globs that "), F.col("path"), F.lit(" explains under `describes`")))
        .when(F.col("freshness") == "orphaned", F.concat(F.lit("`describes` matches nothing ("), F.array_join("missing", ", "), F.lit("): point it at the moved code or delete the doc")))
        .when(F.col("freshness") == "expired", F.lit("read it again, then move the date or drop the time to live"))
        .when(F.col("freshness") == "superseded", F.concat(F.lit("delete it or point to "), F.array_join("superseded_by", ", ")))
        .when(F.col("freshness") == "stale", F.when(n > 0, F.concat(F.lit("review against the "), n.cast("string"), F.lit(" "), T.plural(n, "commit"), F.lit(" since"))).otherwise(F.lit("review and commit the doc again")))
        .when(F.col("freshness") == "drifting", F.when(F.size("changed") > 0, F.concat(F.lit("skim "), F.array_join(F.slice("changed", 1, 3), ", "))).otherwise(F.lit("a quick read will likely clear it")))
        .otherwise(F.lit("nothing to do"))
    )
