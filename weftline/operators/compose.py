"""Map, group, flow and their failure rules over rows with an explicit index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Stage = Callable[[Column], Column]


def map_items(df: DataFrame, items: str, body: Stage, out: str = "result") -> DataFrame:
    """body over each element of an array column, results in input order; an empty list gives an empty list."""
    return df.withColumn(out, F.transform(items, body))


def expand(df: DataFrame, items: str, index: str = "idx", item: str = "item") -> DataFrame:
    """One row for each element, with its index; rows of empty lists have no rows."""
    return df.select("*", F.posexplode(items).alias(index, item)).drop(items)


def gather(df: DataFrame, keys: list[str], value: Column, index: str = "idx", out: str = "result") -> DataFrame:
    """The reverse of expand(): values of each key in the order of index."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), value.alias("v"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda x: x["v"]).alias(out))


def group_members(df: DataFrame, members: dict[str, Stage], on: str) -> DataFrame:
    """Different bodies over the same input: a column for each member, in member order."""
    return df.select("*", *(body(F.col(on)).alias(name) for name, body in members.items()))


def flow(df: DataFrame, stages: list[Stage | Column], on: str) -> DataFrame:
    """Stages one after the other; every stage's result stays, as stage_0, stage_1, ...

    A Column in place of a stage is bound: it ignores what came before.
    """
    before = F.col(on)
    for k, stage in enumerate(stages):
        df = df.withColumn(f"stage_{k}", stage if isinstance(stage, Column) else stage(before))
        before = F.col(f"stage_{k}")
    return df


def flow_outcomes(df: DataFrame, stages: list[Stage], on: Column) -> DataFrame:
    """Stages over outcome structs: a failed stage stops the rest, whose outcomes are null."""
    before = on
    for k, stage in enumerate(stages):
        df = df.withColumn(f"stage_{k}", F.when(before["ok"], stage(before["value"])))
        before = F.col(f"stage_{k}")
    return df


def bind_fields(df: DataFrame, struct: str, **fields: object) -> DataFrame:
    """A copy of a struct column with fields replaced; unknown fields are refused."""
    known = df.schema[struct].dataType.fieldNames()
    if unknown := set(fields) - set(known):
        raise ValueError(f"no such field: {sorted(unknown)}")
    out = F.col(struct)
    for name, value in fields.items():
        out = out.withField(name, value if isinstance(value, Column) else F.lit(value))
    return df.withColumn(struct, out)


def fail_fast(df: DataFrame, keys: list[str], failed: Column, index: str, kind: Column) -> DataFrame:
    """Each composite's state: failed by its failing member of the lowest index, or succeeded."""
    first = F.min(F.when(failed, F.struct(F.col(index).alias("i"), kind.alias("k"))))
    out = df.groupBy(*keys).agg(F.count("*").alias("members"), first.alias("_first"))
    return out.select(*keys, "members", F.when(F.col("_first").isNull(), "succeeded").otherwise("failed").alias("state"), F.col("_first.i").alias("failed_index"), F.col("_first.k").alias("failure_kind"))


def collect_entries(df: DataFrame, keys: list[str], failed: Column, value: Column, kind: Column, message: Column, index: str) -> DataFrame:
    """Every member's entry in order: struct<ok, value, failure struct<kind, message>>, so that no value is taken for a failure."""
    failure = F.when(failed, F.struct(kind.alias("kind"), message.alias("message")))
    entry = F.struct((~failed).alias("ok"), F.when(~failed, value).alias("value"), failure.alias("failure"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), entry.alias("e"))), lambda a, b: F.when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda x: x["e"]).alias("entries"))


def collect_all(df: DataFrame, keys: list[str], failed: Column, value: Column, kind: Column, index: str) -> DataFrame:
    """Every member's value or failure in order, as text, and how many there are of each."""
    entry = F.when(failed, F.concat(F.lit("!"), kind)).otherwise(value.cast("string"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), entry.alias("v"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda x: x["v"]), ",").alias("entries"), F.count_if(failed).alias("failures"), F.count_if(~failed).alias("values"))
