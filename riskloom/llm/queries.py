"""The registered queries over the standard tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import exact_dedup, jaccard_join, language_id, line_dedup, lm_score, mixing, packing, quality, token_counts, warc
from .common import small_batches

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str, python: bool = True) -> DataFrame:
    """A whole table; where its texts go to Python, some at a time."""
    return (small_batches(spark) if python else spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_pages(_table(spark, sf_dir, "pages"), least_bytes=0)
    number = lambda c: F.expr(f"try_cast({c} AS BIGINT)").alias(c)
    gap = F.raise_error(F.concat(F.lit("the archive has a gap: "), "reason")).cast("boolean")  # each page is to come back
    read = read.where(F.when(F.col("record_type").isNull(), gap).otherwise(True))
    return read.select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, size=4096)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_table(spark, sf_dir, "documents")).drop("t1", "t2")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents", python=False))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents", python=False), short=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def queries() -> dict[str, Query]:
    named = [op1_warc, op2_packing, op3_lm_score, op4_exact_dedup, op5_quality, op6_jaccard_join, op7_language_id, op8_mixing, op9_token_counts, op10_line_dedup]
    return {f.__name__: f for f in named}


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
h AS (SELECT page_id, octet_length(raw) AS n, sha1(raw) AS hex, max(page_id) OVER (PARTITION BY raw) AS top FROM p),
b AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (CAST('0x' || substr(hex, CAST(i * 5 // 4 AS BIGINT) + 1, 2) AS BIGINT) // CAST(pow(2, 3 - (i * 5) % 4) AS BIGINT)) % 32 + 1, 1)), '') AS digest
  FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM b
"""

OP4_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
FROM t
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op8_mixing": mixing.QUERY_SQL, "op10_line_dedup": line_dedup.QUERY_SQL}
