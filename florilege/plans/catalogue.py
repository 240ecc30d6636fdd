"""Every registered query with its DuckDB twin."""

from __future__ import annotations

from florilege.plans.oracles import oracle_sql
from florilege.plans.queries import all_queries as queries

__all__ = ["oracle_sql", "queries"]
