"""A small table of named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable:
        """Register a function (spark, sf_dir) under a name, its own by default, with DuckDB SQL where SQL can express it."""

        def add(f: Callable) -> Callable:
            self.queries[name or f.__name__] = f
            if sql is not None:
                self.sql[name or f.__name__] = sql
            return f

        return add
