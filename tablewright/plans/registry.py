"""The list of runnable queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Runner
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    def register(fn: Runner) -> Runner:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(fn, sql)
        return fn

    return register


def all_queries() -> dict[str, Query]:
    from tablewright.plans import (  # noqa: F401
        evaluation_queries,
        feature_queries,
        model_queries,
        report_queries,
        split_queries,
        table_queries,
    )

    return QUERIES
