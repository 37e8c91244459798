"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again for the next one.  All but the last return
the columns of documents.  Columns besides doc_id, text, lang and source pass through,
whatever their names; an empty table stays empty; a text of any length is whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from riskloom.llm.common import materialise, small_batches


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter (null and empty texts too) and those whose language is ambiguous.

    Repeated rows fare alike.  Without a language to learn from all documents go.
    """
    small_batches(spark)
    return language_id.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts keep the one with the smallest id.

    Texts are equal if they are but for the kind and length of blanks; null counts as empty; a null id is the largest; of repeated rows one stays.
    """
    small_batches(spark)
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingles, over any number of links, keep the one with the smallest id.

    Texts without a word are like no other and stay; a null id is the largest; of repeated rows with words one stays.
    """
    small_batches(spark)
    return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that sources come to their target weights, the square roots of their sizes.

    Rows with one id get one count; a row without an id goes by a hash of all its columns; a null source is a source.
    """
    return mixing.mix_sources(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents' tokens into sequences of 4096: a row per piece.

    Null and empty texts are one end token; repeated rows are packed as often as they occur; equal lengths go in the order read.
    """
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, size=4096)


STAGES = [("language_id", language), ("exact_dedup", exact), ("jaccard_join", near), ("mixing", mix), ("packing", pack)]

# Learned language codes, MinHash links and token ids have no SQL form; tests check each stage against a plain version of its own
# (of the language stage: that clean documents stay and those without a letter go).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
