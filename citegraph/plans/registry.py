"""A named collection of queries, each with the SQL that checks it (or none)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(run: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = run
            if sql is not None:
                self.oracle[name] = sql
            return run

        return register

    def include(self, other: "Registry") -> None:
        for name, run in other.queries.items():
            self.query(name, other.oracle.get(name))(run)
