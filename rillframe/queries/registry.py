"""Registering queries: what Spark runs, and the SQL that another engine checks it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillframe.sources.tables import Tables


class Registry:
    """Queries by name, with the checking SQL of those that SQL can express."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, build: Callable[[Tables], DataFrame], oracle: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is there already")
        self.queries[name] = lambda spark, folder: build(Tables(spark, folder))
        if oracle is not None:
            self.oracles[name] = oracle

    def query(self, name: str, oracle: str | None = None):
        """Decorates a function from tables to a DataFrame."""

        def register(build: Callable[[Tables], DataFrame]):
            self.add(name, build, oracle)
            return build

        return register

    def sql(self, name: str, text: str, oracle: str | None = None) -> None:
        """A query in SQL; the same text checks it unless the dialects differ."""
        self.add(name, lambda t: t.sql(text), oracle or text)
