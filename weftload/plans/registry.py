"""The table of registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    check: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, check: str | None = None) -> Callable[[Run], Run]:
    """Register ``run(spark, folder)`` under a name, with SQL that must give the same rows."""

    def add(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, run, check)
        return run

    return add
