"""Corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.llm import mixing, packing, quality_rules, simhash, suffix_dedup
from stockroom.llm.common import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's thresholds. Null
    texts and texts without words fail; repeated rows are judged alike; null
    languages and sources are groups; no documents, no rows."""
    return quality_rules.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the smallest id (null ids
    last; of repeated rows of it one). Empty and null texts are one component;
    no documents, no rows."""
    return simhash.keep_one_per_component(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a smaller id holds; n_chars, where
    there is one, follows. Null texts become empty; extra columns stay,
    whatever their names; repeated rows of one id stay; no documents, no rows."""
    others = [c for c in docs.columns if c != "text"]
    kept = {f"c{i}": c for i, c in enumerate(others)}
    named = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(k) for k, c in kept.items()])
    cut = suffix_dedup.remove_repeats(named, list(kept), with_text=True)

    def column(c: str):
        if c == "text":
            return F.col("text")
        k = next(k for k, name in kept.items() if name == c)
        return (F.length("text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(k)).alias(c)

    return cut.select(*[column(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the source budgets select, each at most once. Null
    texts count one token; repeated rows are selected together; null languages
    and sources are nodes; no documents, no rows."""
    return mixing.mixed_documents(docs, max_epochs=1)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed training sequences; a null or empty text is its
    end mark alone; repeated rows are packed each; no documents, no rows."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("mixing", mix),
    ("packing", pack),
]

# Fingerprints, byte windows and tokens are beyond SQL: tests/llm compares the
# stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
