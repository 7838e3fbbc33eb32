"""A catalog to which a module adds its queries."""

from __future__ import annotations

from collections.abc import Callable


def catalog():
    queries: dict[str, Callable] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None, name: str | None = None):
        def add(f):
            queries[name or f.__name__] = f
            if sql:
                oracles[name or f.__name__] = sql
            return f

        return add

    return query, queries, oracles
