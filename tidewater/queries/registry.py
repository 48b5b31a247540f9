"""Registry of named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidewater.session import ship

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Names, queries and, where SQL can say the same, its text."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            @wraps(fn)
            def run(spark: SparkSession, folder: str) -> DataFrame:
                ship(spark)
                return fn(spark, folder)

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return fn

        return add
