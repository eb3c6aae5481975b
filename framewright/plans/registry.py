"""A decorator that collects a module's queries and their SQL."""

from __future__ import annotations


def registry() -> tuple:
    queries: dict = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query
