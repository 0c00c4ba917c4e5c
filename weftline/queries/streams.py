"""Queries of the streaming operators, run over all files that are there."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.registry import query
from weftline.sources import scratch
from weftline.sources.fixtures import table, with_tables
from weftline.streaming import coalescer


def _events(spark, sf_dir):
    # a stream reads folders; the filter leaves the one table of this folder
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _drained(df, name, mode="append"):
    return coalescer.drain(df, scratch.path(df.sparkSession, name), scratch.path(df.sparkSession, f"{name}-checkpoint"), mode)


@query("A18", "F4", "F9", sql=with_tables("tasks", """
SELECT coalescing_key AS key, max(submitted_ms * 1000) // 1000 AS at, count(*) - 1 AS absorbed, sum(amount)::BIGINT AS payload FROM tasks GROUP BY coalescing_key"""))  # fmt: skip
def stream_coalesce(spark, sf_dir):
    """The live coalescer over the event stream ends where the batch form does."""
    from weftline.sources.fixtures import _SPARK_MS

    rows = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.expr(_SPARK_MS).alias("at"), F.col("event_id").alias("id"), F.round(F.col("value") * 100).cast("bigint").alias("value"))
    updates = _drained(coalescer.coalesce_stream(rows, lambda a, b: a + b), "coalesced", "update")
    return updates.groupBy("key").agg(F.max(F.struct("absorbed", "at", "payload")).alias("s")).select("key", "s.at", "s.absorbed", "s.payload")


@query("B1", sql="SELECT count(*) AS events, count(DISTINCT user_id) AS users FROM events")
def stream_dedup(spark, sf_dir):
    """Ids seen again within the watermark record nothing."""
    rows = _events(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    doubled = rows.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    once = _drained(coalescer.once_by_id(doubled, "event_id", "at", "30 days").select("event_id", "user_id"), "once")
    return once.agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))
