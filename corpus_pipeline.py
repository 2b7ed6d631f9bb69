"""Corpus pipeline: filter, deduplicate, decontaminate, mix and shard ``documents``.

Every stage takes the Parquet table that the stage before it wrote and returns
the columns of ``documents``; the last adds the shard and the slot in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from upslope.llm import decontamination, mixing, ngram_join, quality, sharding
from upslope.scratch import drop_tables, materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null and empty texts have no words and go, an empty table stays empty."""
    return quality.quality_filter(docs)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id.

    Null ids come after all others; null and empty texts are in no group and stay; an empty table stays empty.
    """
    return ngram_join.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``; null texts stay, whatever their id; an empty table drops nothing."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' target weights takes them.

    Texts without words are never taken; null sources are a source; rows that share an id count as one document.
    """
    return mixing.mixed_documents(docs)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in globally shuffled order, cut into 24 shards; every row has a slot, null ids and texts too."""
    carry = [c for c in docs.columns if c != "doc_id"]
    return sharding.shard_records(docs, carry=carry)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_quality),
    ("ngram_jaccard_join", keep_one_of_group),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_to_weights),
    ("sharding", place_in_shards),
]

#: Near duplicates, substitution-tolerant hits and the shuffle are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next; then the table before it goes."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_tables(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
