"""What a user runs on a repository: check, map, pack, search, init, handoff, doctor, conflicts, verify."""

from __future__ import annotations

import argparse
import json
import os
import re
import signal
import subprocess
import sys
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.dims import VERDICTS, Config, severity
from florilege.functions import frontmatter as FM
from florilege.functions import text as T
from florilege.operators import conflicts as C
from florilege.operators import freshness as FR
from florilege.operators import inference as I
from florilege.operators import ranking as R
from florilege.operators import relocation as RL
from florilege.operators import reports as RP
from florilege.sources import config as CF
from florilege.sources import files as FS
from florilege.sources import gitlog as GL
from florilege.sources import history as H
from florilege.sources.tables import stored


@dataclass
class Corpus:
    """A repository's documents with its history and their verdicts."""

    root: str
    config: Config
    docs: DataFrame
    files: DataFrame
    commits: DataFrame
    commit_files: DataFrame
    reports: DataFrame
    is_repo: bool = True
    clock: Column | None = None

    def close(self) -> None:
        """Releases what is held of the corpus on the machines of the cluster."""
        self.reports.unpersist()


def load(spark: SparkSession, root: str, now: datetime | None = None) -> Corpus:
    root = CF.repo_root(root)
    config, repo = CF.load(root), H.is_repo(root)
    docs = stored(FS.read(spark, root, config))
    globs = FS.doc_globs(docs)
    clock = F.lit((now or datetime.now(UTC)).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    if repo:
        # git is asked once, by tasks; all else reads what they wrote
        files, commits, commit_files = (stored(df) for df in (GL.tracked_files(spark, root), *GL.history(spark, root)))
        # plain paths of one repository's claims that lie on disk, tracked or not
        reports = FR.assess(docs, globs, files, commits, commit_files, clock, config, FS.present(globs, root))
        reports = reports.withColumn("reason", FR.reason(reports, clock, config))
    else:
        files, commits, commit_files = (spark.createDataFrame([], ddl) for ddl in ("path string", GL.COMMITS, GL.FILES))
        reports = FR.without_history(docs, globs).withColumn("reason", F.lit("unverified: there is no version control here to check it against"))
    corpus = Corpus(root, config, docs, files, commits, commit_files, reports, repo, clock)
    if repo:
        reports = FR.with_moves(reports, relocations(corpus))
    corpus.reports = reports.withColumn("hint", FR.fix_hint(reports)).persist()
    return corpus


def verify_all(corpus: Corpus, timeout: int = 30) -> DataFrame:
    """(path, passed, code, output) of every document that names a command; each runs on this machine, one after the other."""
    found = [(r.path, verify(corpus, r.path, timeout)) for r in corpus.docs.where("coalesce(trim(verify), '') <> ''").select("path").orderBy("path").collect()]
    return corpus.docs.sparkSession.createDataFrame([(p, v["passed"], v["code"], v["output"]) for p, v in found], "path string, passed boolean, code int, output string")


def check(corpus: Corpus, fail_on: list[str] | None = None, verified: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Reports worst first, and the exit code: 1 where a verdict or a command fails the build, 2 where no named verdict exists."""
    known = [v for v in (fail_on or []) if v in VERDICTS]
    if fail_on and not known:
        return corpus.reports, 2
    failed = RP.failing(corpus.reports, verified, corpus.config, known or None)
    return corpus.reports.orderBy(severity(F.col("freshness")).desc(), "score", "path"), int(failed.limit(1).count() > 0)


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().toLocalIterator()]


def _stamp() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _counts(reports: DataFrame) -> dict[str, int]:
    return RP.counts_map(reports).first().counts


def check_report(corpus: Corpus, fail_on: list[str] | None = None, verified: DataFrame | None = None) -> dict:
    """All that `check` has to say, as one value."""
    rows, code = check(corpus, fail_on, verified)
    known = [v for v in (fail_on or []) if v in VERDICTS]
    warnings = [*corpus.config.warnings, *(f"no verdict {v}" for v in fail_on or [] if v not in VERDICTS)]
    if verified is not None:
        rows = rows.join(verified.select("path", F.struct("passed", "code", "output").alias("verified")), "path", "left").orderBy(severity(F.col("freshness")).desc(), "score", "path")
    failed = [] if code == 2 else [r.path for r in RP.failing(corpus.reports, verified, corpus.config, known or None).select("path").orderBy("path").collect()]
    drift = F.when(F.size("describes") > 0, F.struct("doc_commit", "code_commit", "drift_days", "commits_since", "matched", "missing", F.slice("changed", 1, FR.MOST_FILES).alias("changed")))
    out = rows.select(
        "path", "title", "kind", "id", "owner", "describes", F.col("token_estimate").alias("tokens"), "freshness", "score", F.array("reason").alias("reasons"), drift.alias("drift"), *(["verified"] if verified is not None else []),
        "superseded_by", F.when(F.col("freshness") != "fresh", F.col("hint")).alias("hint"),
    )
    found = _rows(out)
    return {"root": corpus.root, "generated_at": _stamp(), "total": len(found), "counts": _counts(corpus.reports), "fail_on": known or list(corpus.config.fail_on), "failed": failed, "exit_code": code, "warnings": warnings, "docs": found}


def map_report(corpus: Corpus, by: str = "kind") -> dict:
    """Totals, and groups with their entries: verdicts worst first, other groups by their tokens."""
    groups = {r["key"]: {"key": r["key"], "docs": r["docs"], "tokens": r["tokens"], "entries": []} for r in _rows(RP.map_by(corpus.reports, by))}
    entries = RP.map_entries(corpus.reports, by).join(corpus.reports.select("path", "title", "id", "kind", "describes"), "path").orderBy("key", "place")
    for r in _rows(entries):
        groups[r.pop("key")]["entries"].append(r)
    order = (lambda g: -VERDICTS[g["key"]][0]) if by == "freshness" else (lambda g: (-g["tokens"], g["key"]))
    counts = _counts(corpus.reports)
    docs = sum(counts.values())
    totals = {"docs": docs, "tokens": sum(g["tokens"] for g in groups.values()), "unverified": counts["unverified"], "unverified_pct": int(100 * counts["unverified"] / docs + 0.5) if docs else 0, "counts": counts}
    return {"root": corpus.root, "generated_at": _stamp(), "grouped_by": by, "totals": totals, "groups": sorted(groups.values(), key=order)}


def pack(corpus: Corpus, task: str, budget: int | None = None, include_stale: bool = False, kinds: list[str] | None = None) -> DataFrame:
    """Every candidate with its place; the row that was cut carries the text that fits, rows left out the reason."""
    budget = budget or corpus.config.default_budget
    packed = R.pack(corpus.reports, task, budget, include_stale, kinds)
    packed = R.cut_to_fit(packed)
    return packed.withColumn("why", R.left_out(packed, budget))


def pack_markdown(packed: DataFrame, task: str, budget: int | None = None) -> str:
    """A pack as one markdown text: where it is from, contents, the entries in order, then all that was left out and why."""
    rows = packed.select("path", "title", "freshness", "relevance", "rank", "score", "pin", "place", F.coalesce("content", F.lit("")).alias("content"), "tokens", "why").toLocalIterator()
    rows = sorted(rows, key=lambda r: (not r.pin, -r.rank, -r.score, r.path))
    order = [r for r in rows if r.place in ("entry", "cut")]
    rest = sorted((r for r in rows if r.place in ("omitted", "excluded")), key=lambda r: (r.place, r.path))
    used = sum(r.tokens for r in order)
    room = f" of {budget}" if budget else ""
    withheld = sum(r.place == "excluded" for r in rest)
    out = [f"# Context: {task}", "", f"> Made {_stamp()}: {len(order)} documents, about {used}{room} tokens; {len(rest) - withheld} did not fit, {withheld} withheld as out of date.", ""]
    out += ["## Contents", "", *(f"- `{r.path}`: {r.title} ({r.freshness}, relevance {r.relevance:.2f})" for r in order), ""] if order else []
    for r in order:
        out += [f"## {r.title}", f"<!-- {r.path} | {r.freshness} | relevance {r.relevance:.2f}{' | cut' if r.place == 'cut' else ''} -->", "", FM._demoted([r.content], [2])[0], ""]
    if rest:
        out += ["## Left out", ""] + [f"- {r.path}: {r.why}" for r in rest]
    return "\n".join(out) + "\n"


def propose(corpus: Corpus) -> DataFrame:
    """(path, id, kind, globs, confidence) for documents without front matter."""
    bare = corpus.docs.where(~F.col("has_fm"))
    cited = I.describes(I.resolve(I.mentions(bare), corpus.files))
    ids = I.infer_ids(bare.select("path"), corpus.docs.where("id is not null").select("id"))
    heads = bare.select("path", I.kind(F.col("path"), F.col("body"), T.headings(F.col("body"))).alias("kind"))
    found = heads.join(ids, "path").join(cited, "path", "left")
    globs = F.coalesce("globs", F.array().cast("array<string>"))
    return found.select("path", "id", "kind", globs.alias("globs"), I.confidence(globs, F.coalesce("evidence", F.array().cast("array<string>"))).alias("confidence"))


def init(corpus: Corpus, write: bool = False, force: bool = False) -> list[dict]:
    """Proposals; with `write`, also put before the documents' texts, which stay as they are.

    A root that is a home folder, or holds more documents than one project does, is written to only by `force`.
    """
    if write and not force:
        documents = corpus.docs.count()
        if CF.is_home(corpus.root):
            raise PermissionError("refusing to rewrite documents of a home folder")
        if documents > CF.MOST_REWRITTEN:
            raise PermissionError(f"refusing to rewrite documents below a root that holds {documents}")
    found = [r.asDict() for r in propose(corpus).orderBy("path").collect()]
    if write:
        CF.write_starter(corpus.root)
    for p in found if write else []:
        at = CF.safe_path(corpus.root, p["path"])
        with open(at, encoding="utf-8", newline="") as f:
            raw = f.read()
        data = {"spec": FM.SPEC_VERSION, "id": p["id"], "kind": p["kind"]} | ({"describes": p["globs"]} if p["globs"] else {})
        with open(at, "w", encoding="utf-8", newline="") as f:
            f.write(FM.write(data, "") + raw)
    return found


def handoff_docs(corpus: Corpus, task: str, changed: list[str], own: str | None = None) -> DataFrame:
    """The documents that a handoff names, in order, with what is known of them; `own` is the note's own path."""
    side = corpus.files.sparkSession.createDataFrame([(p,) for p in changed], "path string")
    covers = RP.covered(FS.doc_globs(corpus.docs), side)
    scored = R.relevance(corpus.reports, task) if task.strip() else None
    return RP.handoff_tiers(covers, corpus.reports, scored, own).join(corpus.reports.select("path", "title", "freshness", "score", "reason"), "path").orderBy("place")


def handoff(corpus: Corpus, task: str, message: str = "", own: str | None = None) -> tuple[str, DataFrame]:
    """A handoff note, and the documents it names: those that cover changed files, then pinned, then relevant ones."""
    state = H.working_state(corpus.root)
    changed = list(dict.fromkeys([p for _, p in state["changed"]] + state["untracked"]))
    docs = handoff_docs(corpus, task, changed, own)
    rows = docs.collect()  # the note names each
    spark = corpus.docs.sparkSession
    words = {s: w for s, w in spark.createDataFrame([(s,) for s, _ in state["changed"]] or [("M",)], "s string").select("s", RP.status_words(F.col("s"))).collect()}
    note = [r[0] for r in spark.range(1).select(F.explode(RP.bullets(F.lit(message)))).collect()]
    counts = {k: n for k, n in _counts(corpus.reports).items() if n}
    why = lambda r: f"covers {', '.join(r.files[:3])}{f' and {len(r.files) - 3} more' if len(r.files) > 3 else ''}" if r.tier == 0 else "pinned" if r.tier == 1 else "answers to the task"
    out = [f"# Handoff: {task or state['branch'] or 'work in progress'}", "", "## Task", "", task or "Not given; see the changes below.", "", "## State", ""]
    if state["is_repo"]:
        out += [f"- branch {state['branch']} at {state['head']}", f"- {len(state['changed'])} tracked files changed, {len(state['untracked'])} untracked"]
        out += ["", "## Changed", "", *(f"- `{p}`: {words[s]}" for s, p in state["changed"]), *(f"- `{p}`: untracked" for p in state["untracked"][:30])]
        out += [f"- and {len(state['untracked']) - 30} more untracked"] if len(state["untracked"]) > 30 else [] if changed or state["untracked"] else ["- nothing"]
        out += ["", "## Commits", "", *(f"- {c['sha'][:7]} {c['subject']} ({c['author']}, {c['date'][:10]})" for c in state["commits"])]
    else:
        out += ["- no version control"]
    out += ["", "## Read first", "", *(f"- {r.path} ({r.freshness}): {why(r)}" for r in rows)] if rows else ["", "## Read first", "", "- no document covers these files"]
    suspect = [r for r in rows if r.freshness not in ("fresh", "unverified")]
    out += ["", "## Check against the code", "", *(f"- {r.path}: {r.reason}" for r in suspect)] if suspect else []
    out += ["", f"All documents: {sum(counts.values())} ({', '.join(f'{n} {k}' for k, n in counts.items()) or 'none'}).", "", "## Notes", "", *([f"- {x}" for x in note] or ["- none"])]
    fresh = next((r.path for r in rows if r.freshness == "fresh"), None)
    out += ["", "## First steps", "", "1. Read the changes above.", f"2. Read {fresh}." if fresh else "2. Read the code itself; no fresh document covers it.", "3. Run check for what the documents still owe."]
    return "\n".join(out) + "\n", docs


HANDOFF = "docs/handoff.md"


def handoff_note(corpus: Corpus, task: str, message: str = "", to: str | None = None) -> str:
    """A handoff note with front matter that lets it expire; written below the root where `to` names a path."""
    state = H.working_state(corpus.root)
    changed = list(dict.fromkeys(p for _, p in state["changed"] if p != to))
    slug = "-".join(re.findall("[a-z0-9]+", (state["branch"] or "none").lower()))
    head = {"spec": FM.SPEC_VERSION, "id": f"handoff-{slug}-{_stamp()[:10]}", "kind": "handoff", "ttlDays": 7, "tags": ["handoff"]} | ({"describes": changed[:20]} if changed else {})
    text = FM.write(head, handoff(corpus, task, message, to or HANDOFF)[0])
    if to:
        at = CF.safe_path(corpus.root, to)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "w", encoding="utf-8") as f:
            f.write(text)
    return text


def relocations(corpus: Corpus) -> DataFrame:
    """Where the files of dead globs went, from the parent of the newest commit that deleted any of them, with that commit as `left_in`."""
    spark = corpus.docs.sparkSession
    globs = FS.doc_globs(corpus.docs)
    dead = stored(RL.globjoin.missing(globs, corpus.files).select("glob").distinct())
    gone = corpus.commit_files.where("change_type = 'D'")
    hits = RL.globjoin.match(dead, gone).join(gone, "path").join(corpus.commits, "sha")
    left = stored(hits.groupBy("glob").agg(F.max(F.struct(F.col("commit_ts").alias("ts"), "sha", "subject")).alias("left_in")))
    own = left.select("glob", F.concat("left_in.sha", F.lit("^")).alias("rev"))
    bases = [r.rev for r in own.select("rev").distinct().orderBy("rev").collect()]  # as many as dead globs of one repository, at most
    if not bases:
        none = spark.createDataFrame([], "glob string"), corpus.files.limit(0), spark.createDataFrame([], "old_path string, new_path string, similarity int"), corpus.files.limit(0)
        return RL.relocations(*none).withColumn("left_in", F.lit(None).cast("struct<ts:timestamp,sha:string,subject:string>"))
    found = RL.relocations_at(own, GL.trees(spark, corpus.root, bases), GL.renames(spark, corpus.root, bases), corpus.files)
    return found.join(left, "glob", "left")


def doctor(corpus: Corpus) -> DataFrame:
    """Findings in order, blockers first."""
    configured = any(os.path.exists(os.path.join(corpus.root, f)) for f in CF.FILES)
    moves = relocations(corpus) if corpus.is_repo else None
    counts = RP.populations(corpus.reports, moves)
    commits = not corpus.is_repo or H.has_commits(corpus.root)
    return RP.doctor_report(counts, C.duplicate_ids(corpus.docs), C.all_conflicts(corpus.docs), corpus.is_repo, commits, configured).orderBy("place")


def verify(corpus: Corpus, path: str, timeout: int = 30) -> dict | None:
    """Runs the command that a document names, on this machine only; None where it names none. Past the timeout all it started is killed."""
    row = corpus.docs.where(F.col("path") == path).select("verify").first()
    if row is None or not (row.verify or "").strip():
        return None
    try:
        running = subprocess.Popen(row.verify, shell=True, cwd=corpus.root, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, errors="replace", start_new_session=True)
    except OSError as e:
        return {"passed": False, "code": -1, "output": str(e)[:4096]}
    try:
        out, err = running.communicate(timeout=timeout)
    except subprocess.TimeoutExpired:
        os.killpg(running.pid, signal.SIGKILL)
        out, err = running.communicate()
        return {"passed": False, "code": -1, "output": f"{out}{err}\nstopped after {timeout} s".strip()[:4096]}
    code = running.returncode if running.returncode >= 0 else -1
    return {"passed": code == 0, "code": code, "output": (out + err)[:4096]}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="florilege")
    parser.add_argument("command", choices=["check", "map", "pack", "search", "init", "handoff", "doctor", "conflicts", "relocations", "verify"])
    parser.add_argument("task", nargs="*")
    parser.add_argument("--root", default=os.getcwd())
    parser.add_argument("--by", choices=["kind", "freshness", "dir"], default="kind")
    parser.add_argument("--budget", type=int)
    parser.add_argument("--include-stale", action="store_true")
    parser.add_argument("--fail-on", type=lambda s: s.split(","))
    parser.add_argument("--verify", action="store_true")
    parser.add_argument("--verify-timeout", type=int, default=30)
    parser.add_argument("--message", default="")
    parser.add_argument("--out")
    parser.add_argument("--yes", action="store_true")
    parser.add_argument("--force", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    corpus, task, code = load(spark, args.root), " ".join(args.task), 0

    def show(value):
        text = value if isinstance(value, str) else json.dumps(_rows(value) if isinstance(value, DataFrame) else value, indent=2, ensure_ascii=False)
        if args.out:
            with open(args.out, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            print(text)

    if args.command == "check":
        report = check_report(corpus, args.fail_on, verify_all(corpus, args.verify_timeout) if args.verify else None)
        code = report["exit_code"]
        show(report)
    elif args.command == "map":
        show(map_report(corpus, args.by))
    elif args.command == "pack":
        budget = args.budget or corpus.config.default_budget
        show(pack_markdown(pack(corpus, task, budget, args.include_stale), task, budget))
    elif args.command == "search":
        show(R.search(corpus.reports, task).select("path", "relevance", "freshness", T.snippet(F.col("body"), task).alias("snippet")))
    elif args.command == "init":
        show(init(corpus, args.yes, args.force))
    elif args.command == "handoff":
        show(handoff_note(corpus, task, args.message))
    elif args.command == "doctor":
        found = doctor(corpus)
        code = int(found.where("severity = 'blocker'").limit(1).count() > 0)
        show(found)
    elif args.command == "conflicts":
        show(C.ordered(C.all_conflicts(corpus.docs)))
    elif args.command == "verify":
        found = verify_all(corpus, args.verify_timeout)
        code = int(found.where("not passed").limit(1).count() > 0)
        show(found)
    else:
        moves = relocations(corpus)
        show(moves.withColumn("reason", FR.relocation_reason(moves, corpus.clock)))
    return code


if __name__ == "__main__":
    sys.exit(main())
