"""From raw documents to shards: each stage works on what the one before it kept, written as Parquet between them.

Every function takes ``(spark, docs, sf_dir)``. The first four return the columns of the documents; the last adds
``shard``, ``depth``, ``n_bytes`` and ``shard_bytes``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.common import read, written
from ledgerline.llm.decontaminate import clean_documents
from ledgerline.llm.mixing import mixed_documents
from ledgerline.llm.neardup import without_near_duplicates
from ledgerline.llm.quality import accepted_documents
from ledgerline.llm.sharding import shards

#: A perplexity model and a similarity on shingles have no counterpart in SQL; tests compare with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity the trusted text of their language allows."""
    return accepted_documents(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles."""
    return without_near_duplicates(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten consecutive words of the benchmark."""
    return clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard that each goes to."""
    return shards(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = read(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = written(docs, name)
    return docs
