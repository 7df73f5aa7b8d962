"""A corpus run: rejected documents go, near copies and repeated passages go, sources are mixed to
their weights, and what is left is encoded.

Each stage takes the documents that the one before it kept and returns the columns of
``documents``; the last returns a row per mixed text with the digests of its token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlink.llm import mixing, rules, set_join, substrings
from ledgerlink.llm.queries import bpe_digests
from ledgerlink.llm.tables import stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the isolation forest and the base rule keep. Null and empty texts go."""
    return rules.passed(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id. Links take five-word
    shingles and a Jaccard similarity of 0.8 or more."""
    return set_join.one_per_group(docs, size=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words whose 13-word window stands in an earlier one."""
    return substrings.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: whole texts, repeated or not, and cut texts at the ends of quotas."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 per row."""
    return bpe_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules), ("near_copies", near_copies), ("repeated_passages", repeated_passages),
    ("source_mix", source_mix), ("token_ids", token_ids)]
# The forest, the groups of linked documents and the merges are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
