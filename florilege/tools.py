"""What an agent may call on a corpus: seven functions from checked arguments to a text."""

from __future__ import annotations

import math
import os
import re
from datetime import UTC, datetime

from pyspark.sql import functions as F

from florilege import commands as CMD
from florilege.dims import KIND_WEIGHT, VERDICTS, severity
from florilege.functions import frontmatter as FM
from florilege.functions import text as T
from florilege.operators import conflicts as C
from florilege.operators import freshness as FR
from florilege.operators import ranking as R
from florilege.operators import reports as RP
from florilege.sources import config as CF
from florilege.sources import history as H

HANDOFF = ".florilege/handoff.md"
TTL_DAYS = 7
WITHHELD = 20
MOVED = 8


class ToolError(ValueError):
    """Arguments that a tool cannot take."""


def _text(value, key):
    if not isinstance(value, str):
        raise ToolError(f"{key} must be a text")
    return value.strip() or None


def _number(value, key):
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ToolError(f"{key} must be a finite number")
    return value


def _yes(value, key):
    if not isinstance(value, bool):
        raise ToolError(f"{key} must be true or false")
    return value


def _texts(value, key):
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ToolError(f"{key} must be a list of texts")
    return [x.strip() for x in value if x.strip()]


def _of(options, many=False):
    def check(value, key):
        found = _texts(value, key) if many else [x for x in [_text(value, key)] if x]
        for x in found:
            if x not in options:
                raise ToolError(f"{key} must be one of {', '.join(options)}, not {x}")
        return (found if many else found[0]) if found else None

    return check


KINDS = tuple(KIND_WEIGHT)
#: name -> (required arguments, all arguments with what checks them)
ARGUMENTS = {
    "pack": (("task",), {"task": _text, "budget": _number, "include_stale": _yes, "kinds": _of(KINDS, many=True)}),
    "freshness": ((), {"path": _text, "glob": _text}),
    "search": (("query",), {"query": _text, "limit": _number, "min_freshness": _of(tuple(VERDICTS)), "kinds": _of(KINDS, many=True)}),
    "read": (("path",), {"path": _text}),
    "handoff_write": (("task", "summary"), {"task": _text, "summary": _text, "open_questions": _texts, "next_steps": _texts}),
    "handoff_read": ((), {}),
    "conflicts": ((), {}),
}


def checked(name: str, given: dict) -> dict:
    """The arguments of a tool, each of its kind; absent and null ones are left out."""
    if name not in ARGUMENTS:
        raise ToolError(f"no tool {name}; there are {', '.join(ARGUMENTS)}")
    needed, known = ARGUMENTS[name]
    if unknown := [k for k in given if k not in known]:
        raise ToolError(f"{name} takes no {', '.join(unknown)}")
    out = {k: known[k](v, k) for k, v in given.items() if v is not None}
    out = {k: v for k, v in out.items() if v is not None}
    if missing := [k for k in needed if k not in out]:
        raise ToolError(f"{name} needs {', '.join(missing)}")
    return out


def call(corpus: CMD.Corpus, name: str, **given) -> str:
    return TOOLS[name](corpus, **checked(name, given)) if name in TOOLS else checked(name, given)


def _head(corpus: CMD.Corpus, title: str) -> list[str]:
    counts = {k: n for k, n in RP.counts_map(corpus.reports).first().counts.items() if n}
    head = (H.git(corpus.root, "rev-parse", "--short", "HEAD") or "none").strip()
    return [f"# {title}", f"{corpus.root} at {head}; {sum(counts.values())} documents: {', '.join(f'{n} {k}' for k, n in counts.items()) or 'none'}", ""]


def _block(corpus: CMD.Corpus, reports):
    """path and lines of a document's verdict with all that stands behind it."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    lines = F.array_compact(
        F.array(
            F.concat(F.lit("`"), F.col("path"), F.lit("`: "), F.col("freshness"), F.lit(", "), plain("score"), F.lit("/100")),
            FR.meaning(F.col("freshness")),
            F.concat(F.lit("id "), plain("id"), F.lit(", kind "), plain("kind"), F.lit(", owner "), plain("owner"), F.lit(", about "), plain("token_estimate"), F.lit(" tokens")),
            F.when(F.size("describes") > 0, F.concat(F.lit("describes "), F.array_join("describes", ", "))),
            FR.evidence_line(reports),
            F.concat(F.lit("- "), F.col("reason")),
            F.when(F.size("superseded_by") > 0, F.concat(F.lit("- replaced by "), F.array_join("superseded_by", ", "))),
            F.when(F.size("changed") > 0, F.concat(F.lit("- moved since: "), F.array_join(F.slice("changed", 1, MOVED), ", "))),
        )
    )
    return reports.select("path", "title", "freshness", "score", F.array_join(lines, "\n").alias("block"))


def pack(corpus: CMD.Corpus, task: str, budget: float | None = None, include_stale: bool = False, kinds: list[str] | None = None) -> str:
    if budget is not None and budget <= 0:
        raise ToolError("budget must be over 0")
    budget = int(budget or corpus.config.default_budget)
    return CMD.pack_markdown(CMD.pack(corpus, task, budget, include_stale, kinds), task, budget)


def freshness(corpus: CMD.Corpus, path: str | None = None, glob: str | None = None) -> str:
    if path and glob:
        raise ToolError("give path or glob, not both")
    out = _head(corpus, "Freshness")
    if path:
        path = os.path.relpath(CF.safe_path(corpus.root, path), os.path.realpath(corpus.root))
        found = _block(corpus, corpus.reports.where(F.col("path") == path)).first()
        if found is None:
            raise ToolError(f"{path} is not one of the documents")
        return "\n".join([*out, found.block, "", "It may be relied on." if found.freshness == "fresh" else "Check it against the code first."])
    chosen = RP.tool_select(corpus.reports, glob) if glob else corpus.reports
    order = [severity(F.col("freshness")).desc(), "score", "path"]
    rows = chosen.select("path", "freshness", "score", "drift_days", "commits_since", F.size("describes").alias("claims"), "reason").orderBy(*order).collect()  # the table asked for
    out += [f"{len(rows)} documents{f' at {glob}' if glob else ''}", "", "| verdict | score | path | drift | why |", "| --- | --- | --- | --- | --- |"]
    out += [f"| {r.freshness} | {r.score} | `{r.path}` | {f'{r.drift_days}d, {r.commits_since} commits' if r.claims else '-'} | {r.reason.replace('|', '/')} |" for r in rows]
    bad = chosen.where(~F.col("freshness").isin("fresh", "unverified")).orderBy(*order).limit(10)
    blocks = _block(corpus, bad).orderBy(*order).collect()
    return "\n".join(out + (["", f"## The {len(blocks)} worst"] if blocks else []) + [x for b in blocks for x in ("", f"### {b.title}", b.block)])


def search(corpus: CMD.Corpus, query: str, limit: float = 10, min_freshness: str | None = None, kinds: list[str] | None = None) -> str:
    limit = max(1, min(50, math.floor(limit + 0.5)))
    rows = corpus.reports.where(F.col("kind").isin(*kinds)) if kinds else corpus.reports
    found = R.relevance(rows, query).where("relevance > 0").withColumns({"evidence": FR.evidence_line(rows), "snippet": T.snippet(F.col("body"), query)})
    found = found.select("path", "title", "kind", "freshness", "score", "relevance", "token_estimate", "evidence", "snippet").persist()
    kept = RP.worst_acceptable(found, min_freshness) if min_freshness else found
    total, shown = found.count(), kept.orderBy(F.desc("relevance"), F.desc("score"), "path").limit(limit).collect()
    out = [*_head(corpus, "Search"), f"{query}: {total} found, {len(shown)} shown", ""]
    out += [] if shown else ["No document answers to this. Read the code, and consider writing one.", ""]
    for i, r in enumerate(shown, 1):
        out += [f"### {i}. {r.title} ({r.freshness})", f"`{r.path}`: relevance {r.relevance:.2f}, score {r.score}, kind {r.kind or '-'}, about {r.token_estimate} tokens", r.evidence, f"> {r.snippet}", ""]
    if min_freshness:
        left = [r.path for r in RP.below_trust(found, min_freshness, WITHHELD).collect()]
        count = found.where(severity(F.col("freshness")) > severity(F.lit(min_freshness))).count()
        out += [f"## Worse than {min_freshness}: {count}", *(f"- `{p}`" for p in left)] if count else []
    found.unpersist()
    return "\n".join(out)


def read(corpus: CMD.Corpus, path: str) -> str:
    full = CF.safe_path(corpus.root, path)
    path = os.path.relpath(full, os.path.realpath(corpus.root))
    own = corpus.reports.where(F.col("path") == path)
    found = _block(corpus, own).join(own.select("path", "body"), "path").first()
    if found:
        return "\n".join([f"# {found.title}", "", found.block, "", "---", "", found.body])
    try:
        with open(full, encoding="utf-8", errors="replace") as f:
            text = f.read()
    except OSError as e:
        raise ToolError(f"{path} cannot be read: {e.strerror}") from e
    return "\n".join([f"# {path}", "", f"`{path}`: unverified, not one of the documents; nothing is known of it", f"about {FM.estimate(text)} tokens", "", "---", "", text])


def snapshot(root: str) -> dict:
    """Branch, last commit, and the last word of each line of the working state."""
    lines = (H.git(root, "status", "--porcelain") or "").splitlines()
    say = lambda *a: (H.git(root, *a) or "").strip()
    return {"branch": say("rev-parse", "--abbrev-ref", "HEAD") or "unknown", "head": say("log", "-1", "--pretty=%h %s") or "no commits", "changed": [x.split()[-1] for x in lines if x.split()]}


def handoff_write(corpus: CMD.Corpus, task: str, summary: str, open_questions: list[str] = (), next_steps: list[str] = ()) -> str:
    now, state = datetime.now(UTC), snapshot(corpus.root)
    claims = [p for p in state["changed"] if p != HANDOFF][:20]
    head = {"spec": FM.SPEC_VERSION, "id": "handoff", "kind": "handoff", "ttlDays": TTL_DAYS, "updated": now.strftime("%Y-%m-%dT%H:%M:%SZ"), "title": f"Handoff: {task}"} | ({"describes": claims} if claims else {}) | {"tags": ["handoff"]}
    more = len(state["changed"]) - 20
    out = [f"# Handoff: {task}", "", f"Written {head['updated']}; out of date after {TTL_DAYS} days.", "", "## State", "", f"- branch {state['branch']}", f"- last commit {state['head']}", f"- {len(state['changed'])} files changed"]
    out += [f"  - `{p}`" for p in state["changed"][:20]] + ([f"  - and {more} more"] if more > 0 else [])
    out += ["", "## Summary", "", summary, "", "## Open questions", "", *([f"- {q}" for q in open_questions] or ["- none"]), "", "## Next steps", "", *([f"{i}. {x}" for i, x in enumerate(next_steps, 1)] or ["- none"]), ""]
    text = FM.write(head, "\n".join(out))
    at = CF.safe_path(corpus.root, HANDOFF)
    os.makedirs(os.path.dirname(at), exist_ok=True)
    with open(at, "w", encoding="utf-8") as f:
        f.write(text)
    return f"Written to {HANDOFF}: about {FM.estimate(text)} tokens, {len(claims)} changed files as claims, {len(open_questions)} questions, {len(next_steps)} steps."


def handoff_read(corpus: CMD.Corpus, now: datetime | None = None) -> str:
    at = CF.safe_path(corpus.root, HANDOFF)
    try:
        with open(at, encoding="utf-8", errors="replace") as f:
            raw = f.read()
    except OSError:
        return f"# No handoff\n\nThere is no {HANDOFF}; start with a pack."
    said = re.search(r"(?m)^updated:\s*\"?([^\s\"]+)\"?\s*$", raw)
    ttl = re.search(r"(?m)^ttlDays:\s*(\d+)\s*$", raw)
    ttl = int(ttl[1]) if ttl else TTL_DAYS
    try:
        written = datetime.fromisoformat(said[1].replace("Z", "+00:00")) if said else None
    except ValueError:
        written = None
    written = written or datetime.fromtimestamp(os.stat(at).st_mtime, UTC)
    written = written if written.tzinfo else written.replace(tzinfo=UTC)
    days = math.floor(((now or datetime.now(UTC)) - written).total_seconds() / 86_400)
    late = [f"**Out of date: {days} days old, made for {ttl}. Check every line against the repository.**"] if days > ttl else [f"{days} days old, good for {ttl}."]
    found = _block(corpus, corpus.reports.where(F.col("path") == HANDOFF)).first()
    return "\n".join(["# Handoff", "", *late, *([found.block] if found else []), "", "---", "", raw])


def conflicts(corpus: CMD.Corpus) -> str:
    rows = C.ordered(C.all_conflicts(corpus.docs)).collect()  # the list asked for
    out = _head(corpus, "Conflicts")
    if not rows:
        return "\n".join([*out, "None among ids, texts and stated facts; prose is not compared."])
    out += [f"{len(rows)} found", ""]
    for i, r in enumerate(rows, 1):
        out += [f"### {i}. {r.kind} ({r.severity})", "in " + ", ".join(f"`{d}`" for d in r.docs), r.detail, ""]
    return "\n".join(out)


TOOLS = {"pack": pack, "freshness": freshness, "search": search, "read": read, "handoff_write": handoff_write, "handoff_read": handoff_read, "conflicts": conflicts}
