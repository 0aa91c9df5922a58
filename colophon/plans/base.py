"""How plan modules register their queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable


class Queries:
    """``@queries.add(sql)`` registers a function of (session, table directory) under its name."""

    def __init__(self) -> None:
        self.functions: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable:
        def register(function: Callable) -> Callable:
            self.functions[function.__name__] = function
            if sql is not None:
                self.sql[function.__name__] = sql
            return function

        return register
