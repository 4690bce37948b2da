"""Queries with their SQL, gathered module by module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.functions: dict[str, Query] = {}
        self.sql: dict[str, str | Callable[[], str]] = {}

    def __call__(self, sql: str | Callable[[], str] | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.functions[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add

    def queries(self) -> dict[str, Query]:
        return dict(self.functions)

    def oracle_sql(self) -> dict[str, str]:
        return {name: sql if isinstance(sql, str) else sql() for name, sql in self.sql.items()}
