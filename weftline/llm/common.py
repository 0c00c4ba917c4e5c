"""What the operators share: the shared scratch folder, written cut points, partition sizing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no spark.checkpoint.dir and all of Spark is this one machine.
LOCAL_SCRATCH = "file:///tmp/weftline-scratch"
#: Rows of a few numbers that a join may broadcast, about 64 MB.
BROADCAST_ROWS = 1 << 20
#: Bits of a filter by keys for each key, and in all (16 MB); with more keys it only lets more other rows pass.
KEY_BITS, FILTER_BITS = 32, 1 << 27
#: Bits of a row of such a filter, as bitmap_construct_agg has them.
_MAP_BITS = 1 << 15

#: ASCII white space of the word pattern, as the inside of a character class.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (master := spark.sparkContext.master).startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    return (named or LOCAL_SCRATCH).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    path = scratch(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one operator in the shared folder; those not kept are deleted when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """written() for this block only."""
        return self.owned(written(df, name))

    def owned(self, df: DataFrame) -> DataFrame:
        """A written table that ends with the block."""
        self.tables.append(df)
        return df

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """written() for the caller too."""
        return written(df, name)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for df in self.tables:
            discard(df)


def discard(df: DataFrame) -> None:
    """Delete a table that written() made, once nothing reads it."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/weftline-" in path:
            remove(df.sparkSession, path)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table for a join: broadcast if it has so many rows at most, else merged by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df.hint("merge")


class KeyFilter:
    """A set of 64-bit keys as bitmaps of bounded size: passes every row whose key is in the set, and few others."""

    def __init__(self, keys: DataFrame, key: Column, write: Callable[[DataFrame, str], DataFrame], name: str):
        n = max(1, keys.count())
        self.bits = min(FILTER_BITS, max(_MAP_BITS, 1 << (KEY_BITS * n - 1).bit_length()))
        slots = keys.select(self._slot(key).alias("slot")).groupBy(F.shiftright("slot", 15).alias("_f_map"))
        self.maps = write(slots.agg(F.bitmap_construct_agg(F.col("slot") % _MAP_BITS).alias("_f_bits")), name)

    def _slot(self, key: Column) -> Column:
        return F.pmod(key, F.lit(self.bits).cast("bigint"))

    def passed(self, rows: DataFrame, key: Column) -> DataFrame:
        """The rows that may have one of the keys; no shuffle."""
        slot = self._slot(key)
        bit = (slot % _MAP_BITS).cast("int")
        byte = F.conv(F.hex(F.substring(self.maps["_f_bits"], F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = (F.shiftright(slot, 15) == self.maps["_f_map"]) & (F.call_function("getbit", byte, bit % 8) == 1)
        return rows.join(F.broadcast(self.maps), is_set, "left_semi")


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system and path object for a path, on the driver."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path once nothing reads it."""
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    name = f"_w_{stem}"
    while name in taken:
        name += "_"
    return name


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
