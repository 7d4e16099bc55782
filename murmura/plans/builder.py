"""A table of named queries, each with the SQL that gives its rows where there is one."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(f: Callable) -> Callable:
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return keep
