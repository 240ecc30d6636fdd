"""Whether a corpus that was read is still what lies on disk."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable
from concurrent.futures import Future

from florilege.sources import config as CF
from florilege.sources import history as H

KEPT_SECONDS = 30


def _changed(path: str) -> float:
    try:
        return os.stat(path).st_mtime
    except OSError:
        return -1.0


def signature(root: str, paths: list[str]) -> tuple:
    """Head, lines of tracked changes, documents, how many are gone, and the newest change of documents, their folders and the configuration."""
    status = H.git(root, "status", "--porcelain", "--untracked-files=no")
    full = [os.path.join(root, p) for p in paths]
    times = [_changed(p) for p in full]
    folders = {root, *map(os.path.dirname, full)}
    newest = max([t for t in times if t >= 0] + [_changed(f) for f in folders], default=0.0)
    configured = max((_changed(os.path.join(root, f)) for f in CF.FILES), default=0.0)
    return ((H.git(root, "rev-parse", "HEAD") or "").strip(), -1 if status is None else len(status.splitlines()), len(paths), sum(t < 0 for t in times), round(newest * 1000), round(max(configured, 0.0) * 1000))


class Cache:
    """Values by folder, made anew when the folder's signature changes or `kept` seconds have passed.

    Callers that ask for the same folder at once share one build; a build that fails fails for all of
    them and leaves what was held before. A value that is replaced is closed, if it can be.
    """

    def __init__(self, make: Callable, paths: Callable, kept: float = KEPT_SECONDS, clock: Callable[[], float] = time.monotonic) -> None:
        self.make, self.paths, self.kept, self.clock, self.held = make, paths, kept, clock, {}
        self.lock, self.building = threading.Lock(), {}

    def get(self, root: str, force: bool = False):
        """(value, was it made anew?)."""
        with self.lock:
            held, mine = self.held.get(root), None
            build = self.building.get(root)
        if build is None and held and not force and self.clock() - held[2] < self.kept and signature(root, held[3]) == held[1]:
            return held[0], False
        with self.lock:
            build = self.building.get(root)
            if build is None:
                build = mine = self.building[root] = Future()
        if mine is None:
            return build.result(), True
        try:
            value = self.make(root)
            paths = self.paths(value)
            made = value, signature(root, paths), self.clock(), paths
        except BaseException as e:
            with self.lock:
                del self.building[root]
            mine.set_exception(e)
            raise
        with self.lock:
            old, self.held[root] = self.held.get(root), made
            del self.building[root]
        mine.set_result(value)
        if old is not None and old[0] is not value and hasattr(old[0], "close"):
            old[0].close()
        return value, True
