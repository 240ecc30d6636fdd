"""Configuration: a JSON file over the defaults; whatever is wrong in it is warned about and left out."""

from __future__ import annotations

import json
import math
from dataclasses import replace
from pathlib import Path

from florilege.dims import VERDICTS, Config

FILES = ("florilege.config.json", ".florilegerc.json")
KEYS = {"include": "include", "exclude": "exclude", "warnDriftDays": "warn_drift_days", "staleDriftDays": "stale_drift_days", "staleCommitCount": "stale_commit_count", "defaultPackBudget": "default_budget", "failOn": "fail_on"}


def repo_root(start: str) -> str:
    """The nearest folder upwards, a hundred at most, that holds .git; else the start itself."""
    here = Path(start).resolve()
    return str(next((p for p in [here, *here.parents][:100] if (p / ".git").exists()), here))


def load(root: str) -> Config:
    found = next((p for f in FILES if (p := Path(root, f)).is_file()), None)
    if found is None:
        return Config()
    try:
        data = json.loads(found.read_text("utf-8"))
    except ValueError:
        return Config(warnings=(f"{found.name} is not valid JSON; defaults are used",))
    if not isinstance(data, dict):
        return Config(warnings=(f"{found.name} is not an object; defaults are used",))
    return merged(data)


def merged(data: dict) -> Config:
    """Defaults with the settings of data: include replaces, exclude adds, numbers are finite and 0 or more."""
    out, warnings = {}, [f"unknown option {k}" for k in data if k not in KEYS]
    for key, name in KEYS.items():
        if key not in data:
            continue
        own, default = data[key], getattr(Config(), name)
        if name in ("include", "exclude", "fail_on"):
            if not isinstance(own, list) or not all(isinstance(x, str) for x in own):
                warnings.append(f"{key} must be a list of strings")
                continue
            if name == "fail_on":
                warnings += [f"failOn: no verdict {x}" for x in own if x not in VERDICTS]
                own = [x for x in own if x in VERDICTS]
                if data[key] and not own:
                    continue
            out[name] = tuple(dict.fromkeys([*default, *own] if name == "exclude" else own))
        elif isinstance(own, bool) or not isinstance(own, (int, float)) or not math.isfinite(own) or own < 0:
            warnings.append(f"{key} must be a number of 0 or more")
        else:
            out[name] = own
    config = replace(Config(), **out)
    if config.warn_drift_days > config.stale_drift_days:
        warnings.append("warnDriftDays is over staleDriftDays and was lowered to it")
        config = replace(config, warn_drift_days=config.stale_drift_days)
    return replace(config, warnings=tuple(warnings))


def is_home(root: str) -> bool:
    """Is a folder the user's home, where nothing may be rewritten?"""
    return Path(root).resolve() == Path.home().resolve()


def safe_path(root: str, given: str) -> str:
    """A path below root, links resolved; an error for one that leaves it."""
    if "\0" in given:
        raise ValueError("path holds a NUL byte")
    base = Path(root).resolve()
    full = (base / given).resolve()
    if full != base and base not in full.parents:
        raise ValueError(f"{given} lies outside {root}")
    return str(full)


#: more documents than this are not those of one project
MOST_REWRITTEN = 400


def write_starter(root: str) -> bool:
    """Writes the defaults as a configuration file, unless there is one."""
    if any(Path(root, f).exists() for f in FILES):
        return False
    own = {k: getattr(Config(), name) for k, name in KEYS.items() if k != "exclude"}
    Path(root, FILES[0]).write_text(json.dumps({k: list(v) if isinstance(v, tuple) else v for k, v in own.items()}, indent=2) + "\n", "utf-8")
    return True
