"""Named queries: DataFrame functions of (spark, folder of tables), each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by unique normalised name."""

    def __init__(self):
        self._queries: dict[str, Query] = {}
        self._sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        name = name.strip().lower()
        if name in self._queries:
            raise ValueError(f"there is a query {name} already")
        self._queries[name] = query
        if sql:
            self._sql[name] = sql

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(f: Query) -> Query:
            self.add(name, f, sql)
            return f

        return register

    def names(self) -> list[str]:
        return sorted(self._queries)

    def run(self, name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
        try:
            return self._queries[name.strip().lower()](spark, sf_dir)
        except KeyError:
            raise KeyError(f"no query {name}; there are {', '.join(self.names())}") from None

    @property
    def queries(self) -> dict[str, Query]:
        return dict(self._queries)

    @property
    def sql(self) -> dict[str, str]:
        return dict(self._sql)


REGISTRY = Registry()
