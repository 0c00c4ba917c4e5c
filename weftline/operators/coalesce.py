"""Keyed coalescing: newest generation wins, older payloads are folded or dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The newest row of each key with the number of older ones that it absorbed; one aggregation, hot keys combine before the shuffle."""
    row = F.struct(*order, *(c for c in keep if c not in order))
    out = df.groupBy(*keys).agg(F.max(row).alias("_row"), (F.count("*") - 1).alias("absorbed"))
    return out.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in keep), "absorbed")


def superseded(df: DataFrame, keys: list[str], order: list[str], task: str) -> DataFrame:
    """Each older row of a key with the next newer one that replaced it."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("superseded_by", F.lead(task).over(w)).where("superseded_by is not null")


def generations(df: DataFrame, keys: list[str], order: list[str], claimed: Column) -> DataFrame:
    """Generation of each submission: the number of claims of its key before it."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("generation", F.coalesce(F.sum(claimed.cast("bigint")).over(w), F.lit(0)))


def merge_fold(df: DataFrame, keys: list[str], order: list[str], value: Column, merge: Callable[[Column, Column], Column]) -> DataFrame:
    """merge(older, newer) over each key's payloads, oldest first; merge need not be associative."""
    from .reduce import chain

    return chain(df, keys, order, value, merge, out="payload")


def release_chain(older: Column, released: Column, newer: Column) -> Column:
    """The chain of the generation that absorbs a released one: its chain, itself, then the newer's own."""
    return F.concat(older, F.array(released), newer)


def compaction_prefix(df: DataFrame, keys: list[str], order: list[str], size: str, budget: int, soft: int) -> DataFrame:
    """Rows to compact: the longest prefix of each chain within budget, of two rows at least, where the chain is over soft."""
    w = W.partitionBy(*keys).orderBy(*order)
    marked = df.withColumns({"_run": F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum(size).over(W.partitionBy(*keys))})
    taken = marked.where((F.col("_run") <= budget) & (F.col("_all") > soft))
    return taken.withColumn("_n", F.count("*").over(W.partitionBy(*keys))).where("_n >= 2").drop("_run", "_all", "_n")


def apply_compaction(chain: DataFrame, prefix: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: whether the chain still starts with exactly the entries (pos, entry) that were folded, and what remains of it."""
    n = prefix.groupBy(*keys).agg(F.count("*").alias("folded"))
    same = chain.join(prefix.select(*keys, "pos", F.col("entry").alias("_want")), [*keys, "pos"], "full_outer")
    ok = same.groupBy(*keys).agg(F.bool_and(F.col("_want").isNull() | F.coalesce(F.col("entry") == F.col("_want"), F.lit(False))).alias("applies"), F.count("entry").alias("length"))
    return ok.join(n, keys).select(*keys, "applies", F.when(F.col("applies"), F.col("length") - F.col("folded") + 1).otherwise(F.col("length")).alias("length"))


def drop_oldest(df: DataFrame, keys: list[str], order: list[str], size: str, limit: int) -> DataFrame:
    """What a key retains: its newest rows whose sizes together stay within limit."""
    newest_first = W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("_run", F.sum(size).over(newest_first)).where(F.col("_run") <= limit).drop("_run")
