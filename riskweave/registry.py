"""Registration of named queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a query under its function's name; without SQL only its rows are looked at."""

        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return put

    def typed(self, name: str, **types: str) -> None:
        """Gives columns of a query's SQL the types that the query has (sums are wider there)."""
        some = ", ".join(f'CAST("{c}" AS {t}) AS "{c}"' for c, t in types.items())
        self.sql[name] = f"SELECT * REPLACE ({some}) FROM ({self.sql[name]})"
