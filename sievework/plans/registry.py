"""Where the query modules put their queries."""

from __future__ import annotations

from collections.abc import Callable

from sievework.plans.views import view, with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None):
    """Registers f(*frames of the views) as a query, and its SQL over the same views."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views])
        if sql:
            ORACLES[name] = with_views(sql, *views)
        return f

    return add
