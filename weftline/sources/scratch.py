"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where no spark.checkpoint.dir is named and all of Spark is this one machine.
LOCAL = "file:///tmp/weftline-scratch"


def path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (master := spark.sparkContext.master).startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    return f"{(named or LOCAL).rstrip('/')}/engine-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """df as a Parquet table: computed once, its lineage cut, safe from lost executors."""
    at = at or path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
