"""Payloads as chunks, manifests and stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.scan import ordered_scan

CHUNK, RESULT_INLINE, BACKEND_INLINE = 256 << 10, 128 << 10, 64 << 10


def chunks(df: DataFrame, key: str, payload: Column, size: int = CHUNK) -> DataFrame:
    """A row for each piece of a payload, in order: idx, bytes and its digest; an empty payload has none."""
    cut = df.select(key, payload.cast("binary").alias("_p")).withColumn("_n", F.ceil(F.octet_length("_p") / size).cast("int"))
    pieces = cut.where("_n > 0").select(key, "_p", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("idx"))
    part = F.substring("_p", F.col("idx") * size + 1, F.lit(size))
    return pieces.select(key, F.col("idx").cast("bigint").alias("idx"), part.alias("bytes"), F.sha2(part, 256).alias("digest"))


def carried(size: Column) -> Column:
    """How a result of so many bytes travels, and how a backend keeps it."""
    return F.struct((size <= RESULT_INLINE).alias("inline"), (size <= BACKEND_INLINE).alias("backend_inline"), F.when(size <= RESULT_INLINE, 0).otherwise(F.ceil(size / CHUNK)).cast("bigint").alias("blobs"))


def reassemble(manifest: DataFrame, blobs: DataFrame, key: str) -> DataFrame:
    """Payloads put together: ok, missing, corrupt or wrong_length; manifest: key, idx, digest, total; blobs: digest, bytes."""
    joined = manifest.join(blobs, "digest", "left").withColumn("_good", F.sha2("bytes", 256) == F.col("digest"))
    whole = joined.groupBy(key).agg(
        F.max("total").alias("total"), F.count_if(F.col("bytes").isNull()).alias("_missing"), F.count_if(~F.coalesce("_good", F.lit(True))).alias("_corrupt"),
        F.sum(F.octet_length("bytes")).alias("_length"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.decode("bytes", "ISO-8859-1").alias("b")))), lambda x: x["b"]), "").alias("_text"),
    )
    verdict = F.when(F.col("_missing") > 0, "missing").when(F.col("_corrupt") > 0, "corrupt").when(F.col("_length") != F.col("total"), "wrong_length").otherwise("ok")
    return whole.select(key, verdict.alias("verdict"), F.when(verdict == "ok", F.encode("_text", "ISO-8859-1")).alias("payload"))


def manifest_sane(blobs: Column, total: Column, size: int = CHUNK) -> Column:
    """Whether so many full blobs and a last one can hold the total."""
    return (blobs == 0) | total.between((blobs - 1) * size + 1, blobs * size)


def shared_blobs(df: DataFrame) -> DataFrame:
    """Each distinct blob once, with its owners; df: owner, digest, bytes."""
    return df.groupBy("digest").agg(F.count_distinct("owner").alias("owners"), F.count("*").alias("uses"), F.max(F.octet_length("bytes")).cast("bigint").alias("size"))


def garbage(blobs: DataFrame, live: DataFrame) -> DataFrame:
    """Blobs none of whose owners is alive."""
    return blobs.select("digest").distinct().join(blobs.join(live, "owner", "left_semi").select("digest").distinct(), "digest", "left_anti")


def store_entries(heads: DataFrame, parts: DataFrame) -> DataFrame:
    """What is written for a result, in order: its parts first, its head last; both: key, payload."""
    tagged = parts.select("key", "part", F.lit(0).alias("phase")).unionByName(heads.select("key", F.lit(None).cast("bigint").alias("part"), F.lit(1).alias("phase")))
    return tagged


def store_unless_complete(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no complete head yet."""
    return new.join(stored.where("complete").select(key).distinct(), key, "left_anti")


def load(stored: DataFrame, now: int) -> DataFrame:
    """Stored results that have not expired; null never expires."""
    return stored.where(F.col("expires_ms").isNull() | (F.col("expires_ms") > now))


def standing(state: Column, continued: Column, digest: Column) -> Column:
    """How a task stands for a backend, by its newest run."""
    return (
        F.when(state.isNull(), "unknown")
        .when(state.isin("scheduled", "queued", "claimed", "running"), "unfinished")
        .when((state == "succeeded") & continued, "continued")
        .when((state == "succeeded") & digest.isNotNull(), "succeeded")
        .when(state == "succeeded", "unknown")
        .otherwise(F.concat(F.lit("ended:"), state))
    )


def blob_admission(df: DataFrame, order: str, limit: int | None) -> DataFrame:
    """Blobs (shard, digest, size, result, right_key) with the answer that each shard's store gives them in order.

    Too large, of a wrong key, or past the room left is refused and takes none; a blob that is
    held costs nothing; inputs may fill half of the limit. Each store is one sequence, scanned
    in order by one task that holds the store's digests and two sums, never the rows.
    """

    def step(state: tuple[set, int, int], digest: object, size: int, result: bool, right: bool) -> tuple[tuple[set, int, int], str]:
        held, used, inputs = state
        full = limit is not None and (used + size > limit or not result and 2 * (inputs + size) > limit)
        answer = "too_large" if size > CHUNK else "wrong_key" if not right else "stored" if digest in held or not full else "store_full"
        if answer == "stored" and digest not in held:
            held.add(digest)
            used, inputs = used + size, inputs + (0 if result else size)
        return (held, used, inputs), answer

    return ordered_scan(df, ["shard"], [order], lambda: (set(), 0, 0), step, ["digest", "size", "result", "right_key"], "answer", T.StringType())
