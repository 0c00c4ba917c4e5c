"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard_join, line_crf, packing, personal_data, quality_rules, sharding, token_counts, token_store, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed token ids of all documents, written and read back."""
    return token_store.token_store(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document within its edit budget."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents and of their lines."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose 4-word shingles are 85 % alike."""
    found = jaccard_join.similarity_classes(table(spark, sf_dir, "documents"), words=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "copies")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of all documents."""
    return quality_rules.rate(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    return warc.archive(table(spark, sf_dir, "pages"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return personal_data.find(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards of equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents from their lines' marginals."""
    return line_crf.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_token_store, op2_decontamination, op3_packing, op4_token_counts, op5_jaccard_join, op6_quality_rules, op7_warc, op8_personal_data, op9_sharding, op10_quality_classifier)}


#: The one operator whose whole result SQL can express; the others' tests hold them against brute force.
_WARC = """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, max(page_id) AS owner FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM d LEFT JOIN o USING (payload_digest)"""


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": _WARC}
