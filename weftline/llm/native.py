"""Small helpers for expressions that stay inside Spark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tail(array: Column, start: int) -> Column:
    """array from its start-th element on (from 1)."""
    return F.slice(array, start, F.greatest(F.size(array), F.lit(1)))
