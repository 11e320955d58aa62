"""How a module of queries collects them."""

from __future__ import annotations

from collections.abc import Callable


def collector() -> tuple[dict, dict[str, str], Callable]:
    queries: dict = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql is not None:
                oracle[f.__name__] = sql
            return f

        return add

    return queries, oracle, query
