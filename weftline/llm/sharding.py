"""Operator 9, sharding by sampled splitters.

Records are ordered by (hash of the text, hash of doc_id and place), so equal texts lie side
by side. A size-weighted sample of these keys gives quantile boundaries of many more ranges
than shards; ranges that turn out overfull (a hot text) are subdivided by samples of their
own, on the second part of the key. Exact sizes per range, carried over from range to range,
then say which shard and slot each record has: a record belongs to the shard that
its middle byte falls in, so shards are equal in bytes up to one record. Equal texts stay side
by side: a group of them is cut only where a shard ends inside it, as a law of equal bytes must
cut a group that is larger than a shard. Only keys and sizes are shuffled, never texts.

Defined results: null text has size 8 and crc 0; null doc_ids hash as null; repeated rows get
slots of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, written

N_SHARDS = 24
#: Ranges for each shard at least, rows aimed at in a range, samples for each range.
RANGES_A_SHARD, ROWS_A_RANGE, SAMPLES = 16, 200_000, 32
#: Ranges in all before subdividing: bounds samples (24 bytes each, 12 MB) and sums on the driver; beyond it ranges get larger.
MOST_RANGES = 16_384
#: Times the mean at which a range counts as overfull, and rounds of subdividing.
OVERFULL, ROUNDS = 2.0, 4


def _ordered(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Pairs of signed 64-bit numbers as byte strings in the same order."""
    pairs = np.empty((len(first), 2), dtype=">u8")
    pairs[:, 0], pairs[:, 1] = first.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63), second.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return pairs.view("S16").ravel()


def _range_of(splitters: np.ndarray):
    @F.pandas_udf("int")
    def find(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, _ordered(first.to_numpy(), second.to_numpy()), side="right").astype(np.int32))

    return find


def _sampled(rows: DataFrame, total: int, samples: int, seed: int) -> pa.Table:
    """Keys drawn by size: about samples of them, whose number is bounded, the same ones however often this runs."""
    chance = F.col("size") * F.lit(samples / max(total, 1))
    draw = F.shiftrightunsigned(F.xxhash64("first", "second", F.lit(seed)), 11) / F.lit(float(1 << 53))
    return rows.where(draw < chance).select("first", "second", F.greatest(chance, F.lit(1.0)).alias("weight")).toArrow()


def _splitters(sample: pa.Table, n_ranges: int) -> np.ndarray:
    """Weighted quantiles of the sampled keys."""
    if not sample.num_rows or n_ranges < 2:
        return np.zeros(0, dtype="S16")
    keys = _ordered(sample["first"].to_numpy(), sample["second"].to_numpy())
    order = np.argsort(keys)
    passed = np.cumsum(sample["weight"].to_numpy()[order])
    at = np.searchsorted(passed, passed[-1] * np.arange(1, n_ranges) / n_ranges)
    return np.unique(keys[order][np.minimum(at, len(keys) - 1)])


def shard(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """docs (doc_id, text) with size, text_crc32, law, shard, slot, grown_shard; see the module."""
    spark = docs.sparkSession
    text: Column = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.octet_length(text).cast("bigint") + 8).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("first"),
            F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("second"),
        ),
        "shard-keys",
    )
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    n_ranges = max(n_shards * RANGES_A_SHARD, min(MOST_RANGES, -(-count // ROWS_A_RANGE)))
    aim = max((total or 0) / n_ranges, 1)
    splitters = _splitters(_sampled(rows, total or 0, SAMPLES * n_ranges, 0), n_ranges)
    for turn in range(1, ROUNDS + 1):
        placed = rows.withColumn("range", _range_of(splitters)("first", "second"))
        sums = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()  # a row for each range
        over = {r["range"]: r["bytes"] for r in sums if r["bytes"] > OVERFULL * aim and r["rows"] > 1}
        if not over or turn == ROUNDS:
            break
        hot = placed.where(F.col("range").isin(list(over)))
        more = _splitters(_sampled(hot, sum(over.values()), int(SAMPLES * sum(over.values()) / aim) + 1, turn), int(2 * sum(over.values()) / aim) + 2)
        grown = np.unique(np.concatenate([splitters, more]))
        if len(grown) == len(splitters):
            break
        splitters = grown
    before, lines = [0, 0], []
    for r in sorted(sums):
        lines.append((r["range"], before[0], before[1]))
        before = [before[0] + r["bytes"], before[1] + r["rows"]]
    starts = spark.createDataFrame(lines, "range int, bytes_before bigint, rows_before bigint")
    own = W.partitionBy("range").orderBy("first", "second", "doc_id")
    running = own.rowsBetween(W.unboundedPreceding, 0)
    ranked = written(
        placed.withColumn("passed", F.sum("size").over(running))
        .withColumn("nth", F.row_number().over(own))
        .join(F.broadcast(starts), "range")  # a row for each range
        .select(
            "doc_id", "size", "text_crc32",
            F.least(F.expr(f"(2 * (bytes_before + passed) - size) * {n_shards} div {2 * max(total or 0, 1)}"), F.lit(n_shards - 1)).cast("int").alias("shard"),
            (F.col("rows_before") + F.col("nth") - 1).alias("rank"),
        ),
        "shard-ranks",
    )
    discard(rows)
    firsts = ranked.groupBy("shard").agg(F.min("rank").alias("lowest"))
    return ranked.join(F.broadcast(firsts), "shard").select(  # a row for each shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("lowest")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS) -> None:
    """docs as files in a folder for each shard, ordered by slot; rows are matched by doc_id and text."""
    placed = shard(docs, n_shards)
    same = W.partitionBy("doc_id", "text_crc32").orderBy("shard", "slot")
    keys = placed.withColumn("_n", F.row_number().over(same)).select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), "_n", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    nth = F.row_number().over(W.partitionBy("doc_id", crc).orderBy(F.lit(0)))
    whole = docs.withColumns({"_crc2": crc, "_n2": nth})
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_crc2") == F.col("_crc")) & (F.col("_n2") == F.col("_n"))
    joined = whole.join(keys, match).drop("_id", "_crc", "_n", "_crc2", "_n2")
    joined.repartition("_shard").sortWithinPartitions("_shard", "_slot").drop("_slot").write.partitionBy("_shard").parquet(path)
