"""Grouped views of reports: counts, maps, the gate of a build, and findings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.dims import VERDICTS, Config, lookup, severity, verdict_rows
from florilege.functions import globs as G
from florilege.functions import text as T
from florilege.operators.globjoin import by_grams, spread
from florilege.operators.ranking import running_total
from florilege.sources.tables import stored


def verdict_counts(reports: DataFrame) -> DataFrame:
    """All seven verdicts, with 0 where none."""
    counts = reports.groupBy("freshness").agg(F.count(F.lit(1)).cast("int").alias("docs"))
    return verdict_rows(reports.sparkSession).join(counts, "freshness", "left").select("freshness", "severity", F.coalesce("docs", F.lit(0)).alias("docs"))


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.lit("."))


def map_by(reports: DataFrame, key: str) -> DataFrame:
    """(key, docs, tokens) by kind, freshness or dir."""
    by = {"kind": F.coalesce("kind", F.lit("unclassified")), "freshness": F.col("freshness"), "dir": directory(F.col("path"))}[key]
    return reports.select(by.alias("key"), T.token_estimate(F.col("body")).alias("t")).groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("docs"), F.sum("t").cast("long").alias("tokens"))


def gate(reports: DataFrame, config: Config | None = None, fail_on: list[str] | None = None) -> DataFrame:
    """Reports whose verdict fails a build."""
    return reports.where(F.col("freshness").isin(*(fail_on or (config or Config()).fail_on)))


def worst_acceptable(reports: DataFrame, verdict: str) -> DataFrame:
    return reports.where(severity(F.col("freshness")) <= severity(F.lit(verdict)))


def percent(n: Column, total: Column) -> Column:
    return F.when(total == 0, 0).otherwise(F.floor(100 * n / F.greatest(total, F.lit(1)) + 0.5)).cast("int")


def doctor_counts(reports: DataFrame) -> DataFrame:
    """One row: docs, with claims, unprovable, not fresh, and shares in percent."""
    total = F.count(F.lit(1)).cast("int")
    claims = F.count_if(F.size("describes") > 0).cast("int")
    bad = F.count_if(~F.col("freshness").isin("fresh", "unverified")).cast("int")
    one = reports.agg(total.alias("docs"), claims.alias("with_claims"), bad.alias("not_fresh"))
    return one.select("docs", "with_claims", (F.col("docs") - F.col("with_claims")).alias("unprovable"), "not_fresh", percent(F.col("docs") - F.col("with_claims"), F.col("docs")).alias("unprovable_pct"))


def findings(counts: DataFrame, duplicate_ids: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(severity, title): what a health check has to say, from counts of a corpus."""
    dup = duplicate_ids.agg(F.count(F.lit(1)).cast("int").alias("dup"))
    con = conflicts.agg(F.count(F.lit(1)).cast("int").alias("con"))
    row = counts.crossJoin(dup).crossJoin(con)  # one row each
    say = lambda when, level, *title: F.when(when, F.struct(level.alias("severity"), F.concat(*title).alias("title")))
    n = lambda c: F.col(c).cast("string")
    level = lambda major: F.when(major, "major").otherwise("minor")
    found = F.array_compact(
        F.array(
            say(F.col("docs") == 0, F.lit("blocker"), F.lit("no documents matched")),
            say((F.col("docs") > 0) & (F.col("with_claims") == 0), F.lit("major"), F.lit("0 of "), n("docs"), F.lit(" docs can be checked")),
            say((F.col("with_claims") > 0) & (F.col("unprovable") > 0), level(F.col("unprovable") > F.col("docs") / 2), n("unprovable"), F.lit(" of "), n("docs"), F.lit(" docs ("), n("unprovable_pct"), F.lit("%) describe nothing")),
            say(F.col("dup") > 0, F.lit("major"), n("dup"), F.lit(" duplicate ids")),
            say(F.col("con") > 0, F.lit("major"), n("con"), F.lit(" conflicts between docs")),
            say(F.col("not_fresh") > 0, level(F.col("not_fresh") > F.col("docs") / 3), n("not_fresh"), F.lit(" docs are not fresh")),
        )
    )
    return row.select(F.explode(found).alias("f")).select("f.severity", "f.title")


def _handoff_regex(globs: pd.Series) -> pd.DataFrame:
    """Expression, the whole path or the leading folders that every match has, and the grams that it holds."""
    rows = []
    for g in globs:
        fixed, *others = re.split(r"[*?]+", g)
        rows.append((G.handoff_regex(g), fixed if not others else fixed.rsplit("/", 1)[0] if "/" in fixed else "", G.grams([fixed, *others])))
    return pd.DataFrame(rows, columns=["rx", "lead", "grams"])


def covered(doc_globs: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, files): changed files that each document's globs cover, in the handoff dialect.

    Globs meet files by the folder before their first wildcard, those without one by their rarest letters.
    """
    globs = spread(doc_globs.select("glob").where("glob <> ''").distinct(), "glob").withColumn("c", F.pandas_udf(_handoff_regex, "rx string, lead string, grams array<string>")("glob")).select("glob", "c.*")
    files = changed.select(F.col("path").alias("file")).distinct()
    parts = F.split("file", "/")
    leads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    keyed = globs.where("lead <> ''").join(files.withColumn("lead", F.explode(leads)), "lead")
    loose = by_grams(globs.where("lead = ''").select("glob", "rx", "grams"), changed.select("path").distinct()).withColumnRenamed("path", "file")
    hits = keyed.where(F.regexp_like("file", F.col("rx"))).select("glob", "file").unionByName(loose)
    return doc_globs.join(hits, "glob").groupBy("path").agg(F.array_sort(F.collect_set("file")).alias("files"))


def counts_map(reports: DataFrame) -> DataFrame:
    """One row: all seven verdicts with their counts, 0 where none, as a map."""
    rows = verdict_counts(reports)
    entries = F.transform(F.array_sort(F.collect_list(F.struct("severity", "freshness", "docs"))), lambda r: F.struct(r["freshness"], r["docs"]))
    return rows.agg(F.map_from_entries(entries).alias("counts"))


def failing(reports: DataFrame, verified: DataFrame | None = None, config: Config | None = None, fail_on: list[str] | None = None) -> DataFrame:
    """Reports whose verdict, or whose command in verified(path, passed), fails a build."""
    bad = F.col("freshness").isin(*(fail_on or (config or Config()).fail_on))
    if verified is None:
        return reports.where(bad)
    known = verified.select("path", (~F.col("passed")).alias("_broken"))
    return reports.join(known, "path", "left").where(bad | F.coalesce("_broken", F.lit(False))).drop("_broken")


def below_trust(found: DataFrame, verdict: str, most: int = 20) -> DataFrame:
    """The first `most` rows, by path, that `worst_acceptable` leaves out."""
    return found.where(severity(F.col("freshness")) > severity(F.lit(verdict))).orderBy("path").limit(most)


def map_entries(reports: DataFrame, key: str) -> DataFrame:
    """(key, place, path, freshness, score, tokens): the rows of each group of `map_by`, worst first, then the longest.

    There are few kinds and verdicts, so a group may hold most documents: places are counted over ranges of it.
    """
    by = {"kind": F.coalesce("kind", F.lit("unclassified")), "freshness": F.col("freshness"), "dir": directory(F.col("path"))}[key]
    rows = reports.select(by.alias("key"), "path", "freshness", "score", T.token_estimate(F.col("body")).alias("tokens"))
    order = [severity(F.col("freshness")).desc(), F.desc("tokens"), F.col("path")]
    placed = running_total(stored(rows), order, F.lit(1), "place", ("key",))
    return placed.select("key", F.col("place").cast("int").alias("place"), "path", "freshness", "score", "tokens")


def bar(fraction: Column, width: int) -> Column:
    filled = F.greatest(F.lit(0), F.least(F.lit(width), F.floor(fraction * width + 0.5))).cast("int")
    return F.concat(F.repeat(F.lit("#"), filled), F.repeat(F.lit("."), F.lit(width) - filled))


def heat(reports: DataFrame, key: str, cells: int = 24) -> DataFrame:
    """(key, strip, fresh): a letter for each document, worst first, or shares of `cells` where there are more; a bar of what is fresh."""
    by = {"kind": F.coalesce("kind", F.lit("unclassified")), "freshness": F.col("freshness"), "dir": directory(F.col("path"))}[key]
    letters = {v: v[0].upper() if v != "superseded" else "X" for v in VERDICTS}
    counts = reports.groupBy(by.alias("key")).agg(F.count(F.lit(1)).alias("docs"), *[F.count_if(F.col("freshness") == v).alias(f"n_{v}") for v in VERDICTS])
    share = lambda v: F.when(F.col("docs") <= cells, F.col(f"n_{v}")).when(F.col(f"n_{v}") == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.col(f"n_{v}") / F.col("docs") * cells + 0.5))).cast("int")
    strip = F.concat(*[F.repeat(F.lit(letters[v]), share(v)) for v in sorted(VERDICTS, key=lambda v: -VERDICTS[v][0])])
    return counts.select("key", strip.alias("strip"), bar(F.col("n_fresh") / F.col("docs"), 20).alias("fresh"))


def populations(reports: DataFrame, moves: DataFrame | None = None) -> DataFrame:
    """One row of counts: docs, with_frontmatter, with_describes, with_verify, not_fresh, relocated, tokens."""
    has = set(reports.columns)
    yes = lambda c, when: F.count_if(when) if c in has else F.lit(0)
    one = reports.agg(
        F.count(F.lit(1)).cast("int").alias("docs"), yes("has_fm", F.col("has_fm")).cast("int").alias("with_frontmatter"), F.count_if(F.size("describes") > 0).cast("int").alias("with_describes"),
        yes("verify", F.coalesce(F.col("verify") != "", F.lit(False))).cast("int").alias("with_verify"), F.count_if(~F.col("freshness").isin("fresh", "unverified")).cast("int").alias("not_fresh"),
    )
    if moves is None:
        return one.withColumn("relocated", F.lit(0))
    known = moves.where("suggested is not null").select("glob").distinct()
    relocated = reports.select("path", F.explode("missing").alias("glob")).join(known, "glob").agg(F.countDistinct("path").cast("int").alias("relocated"))
    return one.crossJoin(relocated)  # one row each


def doctor_report(counts: DataFrame, duplicate_ids: DataFrame, conflicts: DataFrame, repo: bool = True, commits: bool = True, configured: bool = True) -> DataFrame:
    """(place, severity, title, fix): all that a health check has to say, blockers first, else as listed here."""
    dup = duplicate_ids.agg(F.count(F.lit(1)).cast("int").alias("dup"), F.array_join(F.slice(F.array_sort(F.collect_set("id")), 1, 5), ", ").alias("dup_ids"))
    con = conflicts.agg(F.count(F.lit(1)).cast("int").alias("con"))
    row = counts.crossJoin(dup).crossJoin(con)  # one row each
    n = lambda c: F.col(c).cast("string")
    open_ = F.col("docs") - F.col("with_describes")
    rows = [
        (F.lit(not repo), "blocker", F.lit("not a git repository"), "start one and commit: without history nothing can be checked"),
        (F.lit(repo and not commits), "blocker", F.lit("the repository has no commits"), "commit once, so that there is something to compare with"),
        (F.col("docs") == 0, "blocker", F.lit("no documents matched"), "widen `include` in the configuration"),
        ((F.col("docs") > 0) & (F.col("with_describes") == 0), "major", F.concat(F.lit("0 of "), n("docs"), F.lit(" docs can be checked")), "run init for proposals of `describes`"),
        ((F.col("with_describes") > 0) & (open_ > F.col("docs") / 2), "major", F.concat(open_.cast("string"), F.lit(" of "), n("docs"), F.lit(" docs ("), percent(open_, F.col("docs")).cast("string"), F.lit("%) describe nothing")), "give them `describes`, or run init"),
        ((F.col("with_describes") > 0) & (open_ > 0) & (open_ <= F.col("docs") / 2), "minor", F.concat(open_.cast("string"), F.lit(" of "), n("docs"), F.lit(" docs ("), percent(open_, F.col("docs")).cast("string"), F.lit("%) describe nothing")), "give them `describes`, or run init"),
        (F.col("dup") > 0, "major", F.concat(n("dup"), F.lit(" duplicate ids: "), F.col("dup_ids")), "rename all but one of each"),
        (F.col("con") > 0, "major", F.concat(n("con"), F.lit(" conflicts between docs")), "merge them, or let one supersede the other"),
        (F.col("not_fresh") > F.col("docs") / 3, "major", F.concat(n("not_fresh"), F.lit(" docs are not fresh")), "run check for the next step of each"),
        ((F.col("not_fresh") > 0) & (F.col("not_fresh") <= F.col("docs") / 3), "minor", F.concat(n("not_fresh"), F.lit(" docs are not fresh")), "run check for the next step of each"),
        (F.col("relocated") > 0, "major", F.concat(n("relocated"), F.lit(" docs describe code that moved")), "run check for the new globs"),
        (F.lit(not configured), "minor", F.lit("no configuration file; defaults are used"), "run init with --yes for one"),
        ((F.col("docs") > 0) & (F.col("with_verify") == 0), "minor", F.lit("no doc names a command that verifies it"), "add `verify` to the docs that matter most"),
    ]
    order = {"blocker": 0, "major": 1, "minor": 2, "ok": 3}
    one = lambda i, level, title, fix: F.struct(F.lit(order[level]).alias("o"), F.lit(i).alias("i"), F.lit(level).alias("severity"), title.alias("title"), F.lit(fix).alias("fix"))
    found = F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), one(i, level, title, fix)) for i, (when, level, title, fix) in enumerate(rows)]))
    fine = F.array(one(99, "ok", F.lit("nothing to fix"), "run check on every build to keep it so"))
    listed = row.select(F.posexplode(F.array_sort(F.when(F.size(found) > 0, found).otherwise(fine))).alias("at", "f"))
    return listed.select((F.col("at") + 1).alias("place"), "f.severity", "f.title", "f.fix")


def handoff_tiers(covers: DataFrame, reports: DataFrame, scored: DataFrame | None = None, own: str | None = None, relevant: int = 5) -> DataFrame:
    """(place, path, tier, files): what a handoff names, cover of changed files first, then pinned, then relevant documents.

    covers(path, files); scored(path, relevance): documents that answer to the task, of which those
    with the greatest relevance are taken that are not yet named. The note itself, `own`, is none of them.
    """
    none = F.array().cast("array<string>")
    others = reports.where(F.col("path") != own) if own else reports
    others = stored(others.select("path", "score", "pin"))  # three branches read it
    # all branches below read it
    covering = stored(covers.join(others.select("path", "score"), "path").select("path", F.lit(0).alias("tier"), "files", "score"))
    pinned = others.where("pin").join(covering.select("path"), "path", "left_anti").select("path", F.lit(1).alias("tier"), none.alias("files"), "score")
    named = covering.unionByName(pinned)
    if scored is not None:
        open_ = scored.where("relevance > 0").select("path", "relevance").join(others.select("path", "score"), "path").join(named.select("path"), "path", "left_anti")
        best = open_.orderBy(F.desc("relevance"), F.desc("score"), "path").limit(relevant)
        named = named.unionByName(best.select("path", F.lit(2).alias("tier"), none.alias("files"), "score"))
    order = [F.col("tier"), F.desc(F.size("files")), F.desc("score"), F.col("path")]
    return running_total(stored(named), order, F.lit(1), "place").select(F.col("place").cast("int").alias("place"), "path", "tier", "files")


def handoff_age(docs: DataFrame, now: Column, ttl_days: int = 7) -> DataFrame:
    """(path, age_days, ttl_days, expired) of handoffs docs(path, written, ttl_days): whole days since they were written."""
    ttl = F.coalesce("ttl_days", F.lit(ttl_days))
    age = F.floor((F.unix_millis(now) - F.unix_millis("written")) / 86_400_000).cast("int")
    return docs.select("path", age.alias("age_days"), ttl.cast("int").alias("ttl_days"), F.coalesce(age > ttl, F.lit(False)).alias("expired"))


# What the letters of a working state's status stand for.
STATUS_WORDS = {"M": "modified", "A": "added", "D": "deleted", "R": "renamed", "C": "copied", "U": "conflicted", "?": "untracked"}


def status_words(code: Column) -> Column:
    """Words for a status code, each once, in order."""
    letters = F.filter(F.split(F.regexp_replace(code, r"\s", ""), ""), lambda x: x != "")
    words = F.array_distinct(F.transform(letters, lambda x: F.coalesce(lookup(x, STATUS_WORDS), x)))
    return F.when(F.size(words) == 0, "changed").otherwise(F.array_join(words, "/"))


def bullets(message: Column) -> Column:
    """A note as points: at line ends, and after sentences that a capital follows."""
    parts = F.split(message, r"\n|(?<=[.?!])\s+(?=[A-Z])")
    return F.filter(F.transform(parts, T.trimmed), lambda x: x != "")


def tool_select(paths: DataFrame, glob: str) -> DataFrame:
    """Rows of paths(path, ...) that a glob of the tools' dialect selects."""
    return paths.where(F.col("path").rlike(G.tool_regex(glob.removeprefix("./"))))


def earlier(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as date text a is before, at or after b; texts that are no dates compare as text."""
    x, y = F.try_to_timestamp(a), F.try_to_timestamp(b)
    by_time = F.when(x < y, -1).when(x > y, 1).otherwise(0)
    return F.when(x.isNull() | y.isNull(), F.when(a < b, -1).when(a > b, 1).otherwise(0)).otherwise(by_time)
