"""Row numbers and running values within few and large keys.

Rows are range-partitioned by key and order, scanned inside a partition, and then given what the
partitions before them hold of their key: a key that holds most rows is many tasks' work. What
partitions carry over is a row for each partition and key in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.sources import scratch


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, how: str, out: str) -> DataFrame:
    """df with the sum of value up to each row in its key, or its last value there that isn't null; keys and order together tell rows apart."""
    parts = scratch.written(df.withColumn("_v", value).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "running")
    upto = W.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    if how == "sum":
        whole, before, own = F.sum("_v"), F.sum("_whole").over(earlier), F.sum("_v").over(upto)
        both = F.coalesce("_before", F.lit(0)) + F.coalesce("_own", F.lit(0))
    else:
        known = F.struct(F.struct(*order).alias("at"), "_v")
        whole = F.max(F.when(F.col("_v").isNotNull(), known))["_v"]
        before, own = F.last("_whole", ignorenulls=True).over(earlier), F.last("_v", ignorenulls=True).over(upto)
        both = F.coalesce("_own", "_before")
    carried = parts.groupBy(*keys, "_part").agg(whole.alias("_whole")).select(*keys, "_part", before.alias("_before"))
    return parts.withColumn("_own", own).join(carried, [*keys, "_part"]).select(*df.columns, both.alias(out))


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """df with each row's number in its key, from 1; keys and order together tell rows apart."""
    return running(df, keys, order, F.lit(1).cast("bigint"), "sum", out)
