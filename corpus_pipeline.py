"""A corpus pipeline of five operators: rules, exact duplicates, near duplicates, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import exact_dedup, ngram_join, packing, quality_rules, secrets
from helixframe.llm.common import drop_others, prepare, save, written
from helixframe.llm.queries import PATTERN, RANKS


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar texts the one with the smallest doc_id stays."""
    return ngram_join.keep_one(docs)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    return secrets.redact(docs, RANKS, PATTERN, length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of all texts, in pieces, with their buckets and batches."""
    return packing.pack_documents(docs, RANKS, PATTERN)


STAGES = [("quality rules", rules), ("exact dedup", copies), ("n-gram Jaccard join", near_copies), ("secret scans", no_secrets), ("packing", packed)]

#: The stages compress, hash and tokenise: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again.  Of the tables written on the way only the last stays."""
    prepare(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_others(spark, before, docs)
    return docs
