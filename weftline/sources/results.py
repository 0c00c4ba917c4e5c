"""A result backend on Parquet: parts before heads, expiry, digests checked on reading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



class ResultStore:
    """Results under a path: key, payload, digest, expires_ms, in a folder for each prefix (hex digits) of the key's hash."""

    def __init__(self, spark: SparkSession, path: str, digits: int = 2):
        self.spark, self.path, self.prefix = spark, path.rstrip("/"), f"substring(sha2(key, 256), 1, {digits})"

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def store(self, df: DataFrame, ttl_ms: int | None, now_ms: int) -> None:
        """Store results (key, payload, and expires_ms where a result has its own) that aren't complete yet; a head is written only after its payload."""
        until = F.lit(None if ttl_ms is None else now_ms + ttl_ms).cast("bigint")
        until = F.col("expires_ms").cast("bigint") if "expires_ms" in df.columns else until
        new = df.select(F.col("key").cast("string").alias("key"), F.col("payload").cast("binary").alias("payload"), until.alias("expires_ms")).dropDuplicates(["key"])
        if self.exists():
            new = new.join(self.heads().select("key"), "key", "left_anti")
        new = new.withColumns({"digest": F.sha2("payload", 256), "prefix": F.expr(self.prefix)}).repartition("prefix")
        new.select("key", "payload", "prefix").write.mode("append").partitionBy("prefix").parquet(f"{self.path}/parts")
        new.select("key", "digest", "expires_ms", "prefix").write.mode("append").partitionBy("prefix").parquet(f"{self.path}/heads")

    def exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/heads/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def heads(self) -> DataFrame:
        return self._read("heads", "key string, digest string, expires_ms bigint, prefix string")

    def load(self, keys: list[str] | None, now_ms: int) -> DataFrame:
        """key, payload of results that are held, not expired and undamaged; all, or those asked for."""
        heads = self.heads().where(F.col("expires_ms").isNull() | (F.col("expires_ms") > now_ms))
        if keys is not None:
            heads = heads.where(F.col("key").isin(keys))
        parts = self._read("parts", "key string, payload binary, prefix string").dropDuplicates(["key"])
        return heads.join(parts, ["prefix", "key"]).where(F.sha2("payload", 256) == F.col("digest")).select("key", "payload")


def deliver(df: DataFrame, callback: Callable[[dict], None], log: Callable[[str], None] = print) -> int:
    """Call back for each row, streamed to the driver a partition at a time; a callback's errors are only logged."""
    n = 0
    for row in df.toLocalIterator(prefetchPartitions=True):
        n += 1
        try:
            callback(row.asDict(recursive=True))
        except Exception as e:  # the result stands whatever the callback does
            log(f"callback failed: {type(e).__name__}: {e}")
    return n
