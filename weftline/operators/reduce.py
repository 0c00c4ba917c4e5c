"""Ordered folds: chain, tree, their plans and their edge cases.

A chain folds one key's items in order and so holds them in one row; where the reducer is
associative use the tree, whose chunks are folded in parallel and whose partial results alone
meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Merge = Callable[[Column, Column], Column]
DEFAULT_CHUNK = 64


def _fold(values: Column, merge: Merge, seed: Column | None) -> Column:
    if seed is not None:
        return F.aggregate(values, seed, merge)
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.aggregate(rest, F.get(values, F.lit(0)), merge)


def _in_order(order: list[Column], value: Column) -> Column:
    key = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)))
    return F.transform(F.array_sort(F.collect_list(F.struct(key.alias("o"), value.alias("v")))), lambda x: x["v"])


def chain(df: DataFrame, keys: list[str], order: list[str], value: Column, merge: Merge, seed: Column | None = None, out: str = "result") -> DataFrame:
    """Left fold of each key's values in order; without a seed the first item starts."""
    listed = df.groupBy(*keys).agg(_in_order([F.col(c) for c in order], value).alias("_items"))
    return listed.select(*keys, F.size("_items").cast("bigint").alias("items"), _fold(F.col("_items"), merge, seed).alias(out))


def pairwise(parts: Column, merge: Merge) -> Column:
    """Partial results joined in pairs left to right, level after level; an odd one is carried up."""

    def level(now: Column, _: Column) -> Column:
        slots = F.sequence(F.lit(0), F.ceil(F.size(now) / 2).cast("int") - 1)
        return F.transform(slots, lambda k: F.when(2 * k + 1 < F.size(now), merge(F.get(now, 2 * k), F.get(now, 2 * k + 1))).otherwise(F.get(now, 2 * k)))

    levels = F.ceil(F.log2(F.greatest(F.size(parts), F.lit(1)).cast("double"))).cast("int")
    rounds = F.when(levels > 0, F.sequence(F.lit(1), F.greatest(levels, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.get(F.aggregate(rounds, parts, level), F.lit(0))


def tree(df: DataFrame, keys: list[str], index: str, value: Column, merge: Merge, chunk: int = DEFAULT_CHUNK, seed: Column | None = None, combine: Merge | None = None, out: str = "result") -> DataFrame:
    """Chunks of consecutive items folded side by side, their results joined pairwise in order.

    merge is associative, or combine joins two partial results. A seed starts every chunk and
    must be an identity.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(index) / chunk))
    partial = chunked.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"), _in_order([F.col(index)], value).alias("_items"))
    partial = partial.withColumn("_part", _fold(F.col("_items"), merge, seed))
    whole = partial.groupBy(*keys).agg(F.sum("_n").alias("items"), F.count("*").alias("chunks"), _in_order([F.col("_chunk")], F.col("_part")).alias("_parts"))
    return whole.select(*keys, "items", "chunks", (2 * F.col("chunks") - 1).alias("steps"), pairwise(F.col("_parts"), combine or merge).alias(out))


def guarded(values: Column, merge: Merge, seed: Column | None) -> Column:
    """A fold of an array with the edge cases: empty gives the seed, or an error where there is none."""
    folded = _fold(values, merge, seed)
    empty = seed if seed is not None else F.raise_error(F.lit("ReduceEmptyError"))
    return F.when(F.size(values) == 0, empty).otherwise(folded)


def chain_steps(n: Column, seeded: bool) -> Column:
    """Merge calls of a chain over n items."""
    return F.greatest(n - (0 if seeded else 1), F.lit(0)).cast("bigint")


def tree_plan(counts: DataFrame, items: str, chunk: int) -> DataFrame:
    """The tree's nodes (level, slot, width) for each row: chunks at level 0, then pairs left to right, an odd slot carried up."""
    base = counts.withColumn("width", F.ceil(F.col(items) / chunk).cast("bigint")).where("width > 0")
    levels = base.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.log2("width")).cast("bigint"))).alias("level"))
    wide = levels.withColumn("nodes", F.ceil(F.col("width") / F.pow(F.lit(2.0), F.col("level"))).cast("bigint"))
    return wide.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nodes") - 1)).alias("slot")).select(*counts.columns, "level", "slot", "nodes")


def startable(plan: DataFrame, settled: DataFrame, keys: list[str]) -> DataFrame:
    """Plan nodes above level 0 that are not settled and whose operands all are."""
    pending = plan.join(settled, [*keys, "level", "slot"], "left_anti").where("level > 0")
    operands = pending.select(*keys, "level", "slot", F.explode(F.array(2 * F.col("slot"), 2 * F.col("slot") + 1)).alias("operand"))
    below = plan.select(*keys, (F.col("level") + 1).alias("level"), F.col("slot").alias("operand"))
    missing = operands.join(below, [*keys, "level", "operand"]).join(settled.select(*keys, (F.col("level") + 1).alias("level"), F.col("slot").alias("operand")), [*keys, "level", "operand"], "left_anti")
    return pending.join(missing.select(*keys, "level", "slot").distinct(), [*keys, "level", "slot"], "left_anti")
