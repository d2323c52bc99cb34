"""Query registry: each plan module offers QUERIES (name -> callable) and ORACLES (name -> SQL)."""

from __future__ import annotations

import importlib
from functools import cache

#: Modules under tapewright.plans, in the order in which their queries are listed.
PLAN_MODULES = ("flagship", "indicators", "statistics", "portfolios", "aggregates", "preparation", "sequential", "records", "risk", "costs", "checks", "evaluation", "searches", "depth", "layouts", "points", "selection", "stationarity", "stores", "health")


@cache
def _modules():
    return tuple(importlib.import_module(f"tapewright.plans.{m}") for m in PLAN_MODULES)


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: without_negative_zero(v) for m in _modules() for k, v in m.ORACLES.items()}


def without_negative_zero(sql: str) -> str:
    """Adds 0.0 to every round(...): a rounded -0.0 becomes 0.0, as in the queries."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 0, start + len("round")
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if depth == 0:
                break
        inner = without_negative_zero(sql[start + len("round(") : end - 1])
        out += [sql[at:start], f"(round({inner}) + 0.0::DOUBLE)"]
        at = end
    return "".join(out) + sql[at:]
