"""What every module of queries has: queries by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable


def collection() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """(queries, sql, query): ``query(sql)`` adds the function below it to both."""
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None):
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query
