"""How plan modules register queries: a function, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.functions.rounding import half_up
from panelloom.sources.adapters import with_views

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, views: str | None = None, sql: str | None = None) -> Callable[[Query], Query]:
        def put(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql is not None:
                self.sql[query.__name__] = with_views(views, sql) if views else sql
            return query

        return put


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All doubles rounded, so that the order of sums doesn't show; -0.0 becomes 0.0."""
    return df.select(*((half_up(c, places) + 0.0).alias(c) if t == "double" else (F.round(c, places) + 0.0).alias(c) if t == "float" else F.col(c) for c, t in df.dtypes))
