"""Registration of a named query together with its oracle."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    """``(QUERIES, ORACLES, query)`` for a plan module; ``@query(sql)`` registers the function under its own name."""
    queries: dict = {}
    oracles: dict = {}

    def query(sql: str | None = None) -> Callable:
        def add(fn: Callable) -> Callable:
            queries[fn.__name__] = fn
            if sql:
                oracles[fn.__name__] = sql
            return fn

        return add

    return queries, oracles, query
