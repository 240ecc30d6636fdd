"""Fixed values of the domain: verdicts, kinds, fields, and the default configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity, rank weight, and score band of each verdict.
VERDICTS = {
    "fresh": (0, 1.0, (70, 100)),
    "unverified": (1, 0.75, (50, 50)),
    "drifting": (2, 0.6, (40, 85)),
    "stale": (3, 0.25, (10, 55)),
    "expired": (4, 0.15, (5, 30)),
    "orphaned": (5, 0.1, (3, 20)),
    "superseded": (6, 0.05, (0, 10)),
}
DEGRADED = ("stale", "expired", "orphaned", "superseded")
# Rank weight of each kind, and of documents without one.
KIND_WEIGHT = {"decision": 1.15, "runbook": 1.15, "spec": 1.1, "handoff": 1.05, "reference": 1.0, "guide": 0.95, "index": 0.8}
NO_KIND_WEIGHT = 0.9
# What a hit in each field weighs.
FIELD_WEIGHT = {"title": 3.0, "id": 3.0, "headings": 2.0, "tags": 1.5, "path": 1.2, "body": 1.0}
FRONT_FIELDS = ("spec", "id", "kind", "describes", "verify", "owner", "expires", "ttlDays", "supersedes", "tags", "pin")

# Folders that hold no documents of the user's own.
EXCLUDE = (
    *("**/node_modules/**", "**/.git/**", "**/dist/**", "**/build/**", "**/vendor/**", "**/CHANGELOG.md", "**/.venv/**", "**/venv/**", "**/site-packages/**", "**/__pycache__/**"),
    *("**/.tox/**", "**/*.egg-info/**", "**/.next/**", "**/.nuxt/**", "**/.svelte-kit/**", "**/.turbo/**", "**/bower_components/**", "**/Pods/**", "**/.terraform/**"),
    *("**/.gradle/**", "**/coverage/**", "**/.cache/**"),
)


@dataclass(frozen=True)
class Config:
    include: tuple[str, ...] = ("**/*.md", "**/*.mdx")
    exclude: tuple[str, ...] = EXCLUDE
    stale_drift_days: int = 45
    warn_drift_days: int = 14
    stale_commit_count: int = 10
    fail_on: tuple[str, ...] = ("stale", "expired", "orphaned")
    default_budget: int = 8000
    warnings: tuple[str, ...] = field(default=(), compare=False)

    @property
    def warn_commit_count(self) -> int:
        return max(2, -(-max(1, self.stale_commit_count) // 2))


def lookup(key: Column, table: dict, default=None) -> Column:
    """A small constant table as one expression, so that no join is planned."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def severity(verdict: Column) -> Column:
    return lookup(verdict, {k: v[0] for k, v in VERDICTS.items()})


def verdict_of(level: Column) -> Column:
    return lookup(level, {v[0]: k for k, v in VERDICTS.items()})


def verdict_rows(spark):
    """The seven verdicts as a table: freshness, severity."""
    return spark.createDataFrame([(k, v[0]) for k, v in VERDICTS.items()], "freshness string, severity int")
