"""Queries by name, each with the operators it covers and, where one exists, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    operators: tuple[str, ...]
    build: Build
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(*operators: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def add(build: Build) -> Build:
        if build.__name__ in QUERIES:
            raise ValueError(f"{build.__name__} is registered twice")
        QUERIES[build.__name__] = Query(build.__name__, operators, build, sql)
        return build

    return add
