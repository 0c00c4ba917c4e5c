"""Continuations: a body that returns a plan, which runs next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tree import Step


def continued(df: DataFrame, choice: Column, plans: dict[str, Step], on: str, out: str = "result") -> DataFrame:
    """df with, as JSON, the results of the plan that each row's body chose; null where it chose none.

    The driver knows all plans that a body may return, so they become branches of one projection
    and Catalyst evaluates for each row only the one that it needs.
    """
    given, result = F.col(on), None
    for name, plan in plans.items():
        value = F.to_json(F.struct(plan.column(given).alias("r")))
        result = F.when(choice == name, value) if result is None else result.when(choice == name, value)
    return df.withColumn(out, result)
