"""A repository's history as tables, and small calls to git."""

from __future__ import annotations

import os
import re
import subprocess

TIMEOUT = 20  # seconds, of small calls
MOST_BYTES = 64 << 20  # of their output
RENAMES = 5000


class HistoryError(RuntimeError):
    """History could not be read whole; no part of it stands for all of it."""


def _command(root: str, *args: str) -> list[str]:
    return ["git", "-c", "core.quotepath=off", "--no-pager", "-C", root, *args]


def git(root: str, *args: str) -> str | None:
    """Output of a small read-only git command; None where git refuses, takes longer than TIMEOUT or says more than MOST_BYTES."""
    try:
        done = subprocess.run(_command(root, *args), capture_output=True, timeout=TIMEOUT, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return None if len(done.stdout) > MOST_BYTES else done.stdout.decode("utf-8", "replace")


def stream(root: str, separator: bytes, *args: str):
    """Records of a git command's output of any length and duration; an error if it fails."""
    try:
        done = subprocess.Popen(_command(root, *args), stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    except OSError as e:
        raise HistoryError(str(e)) from e
    rest = b""
    with done:
        while block := done.stdout.read(1 << 20):
            *whole, rest = (rest + block).split(separator)
            for record in whole:
                yield record.decode("utf-8", "replace")
        if rest:
            yield rest.decode("utf-8", "replace")
        said = done.stderr.read().decode("utf-8", "replace").strip()
    if done.returncode:
        raise HistoryError(f"git {args[0]}: {said or f'exit code {done.returncode}'}")


def is_repo(root: str) -> bool:
    return os.path.exists(os.path.join(root, ".git")) or git(root, "rev-parse", "--git-dir") is not None


def has_commits(root: str) -> bool:
    return git(root, "rev-parse", "--verify", "-q", "HEAD") is not None


def working_state(root: str, commits: int = 8) -> dict:
    """Branch, short head, last commits, and the changed and untracked files of the working tree."""
    if not is_repo(root):
        return {"is_repo": False, "branch": None, "head": None, "commits": [], "changed": [], "untracked": []}
    text = lambda *a: (git(root, *a) or "").strip() or None
    log = (git(root, "log", f"-{commits}", "--format=%H%x1f%aI%x1f%s%x1f%an") or "").strip()
    changed, untracked = [], []
    for line in (git(root, "status", "--porcelain=v1") or "").splitlines():
        status, path = line[:2], re.sub(r"^.* -> ", "", line[3:]).strip('"')
        (untracked if status == "??" else changed).append(path if status == "??" else (status.strip(), path))
    return {
        "is_repo": True, "branch": text("rev-parse", "--abbrev-ref", "HEAD"), "head": text("rev-parse", "--short", "HEAD"),
        "commits": [dict(zip(("sha", "date", "subject", "author"), x.split("\x1f"), strict=True)) for x in log.splitlines()], "changed": changed, "untracked": untracked,
    }
