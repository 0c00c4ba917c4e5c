"""Coalescing, deduplication and drift over streams, with state that survives restarts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Coalescer(StatefulProcessor):
    """Newest generation of each key, how many it absorbed and the fold of their payloads, oldest first.

    Input columns: key, at, id, value. Late rows of an older generation are absorbed, not folded
    again in order: the stream's order within a key is what is folded.
    """

    def __init__(self, merge: Callable[[int, int], int] | None = None):
        self.merge = merge or (lambda older, newer: newer)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("held", "at bigint, id bigint, absorbed bigint, payload bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        for part in rows:
            for at, id_, value in part.sort_values(["at", "id"])[["at", "id", "value"]].itertuples(index=False):
                if held is None:
                    held = (int(at), int(id_), 0, int(value))
                else:
                    newest = max((held[0], held[1]), (int(at), int(id_)))
                    held = (*newest, held[2] + 1, int(self.merge(held[3], int(value))))
        self.state.update(held)
        yield pd.DataFrame({"key": [key[0]], "at": [held[0]], "id": [held[1]], "absorbed": [held[2]], "payload": [held[3]]})

    def close(self) -> None:
        pass


def coalesce_stream(df: DataFrame, merge: Callable[[int, int], int] | None = None) -> DataFrame:
    """Updates of each key's coalesced generation; df: key, at, id, value."""
    out = "key string, at bigint, id bigint, absorbed bigint, payload bigint"
    return df.groupBy("key").transformWithStateInPandas(statefulProcessor=Coalescer(merge), outputStructType=out, outputMode="Update", timeMode="None")


def once_by_id(df: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first row of each id within the watermark's delay."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(df: DataFrame, time: str, delay: str, window: str, *keys: str) -> DataFrame:
    """Counts by tumbling window and keys; rows later than the delay are dropped."""
    return df.withWatermark(time, delay).groupBy(F.window(time, window), *keys).count()


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a streaming frame over all that is available now; its output as a Parquet table at path, a folder for each batch."""
    spark = df.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a repeated batch replaces itself

    spark.createDataFrame([], df.schema).write.parquet(f"{path}/batch=-1")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)
    try:
        df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(df.schema).parquet(path).drop("batch")
