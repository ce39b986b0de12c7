"""The corpus pipeline: language identification, one document of each group of near copies, benchmark
passages cut out, sources mixed to target weights, shards. Each stage works on what the one before kept.

Defined results: NULL texts, empty ones and those without a letter go with the first stage; without any labelled row it keeps all that have a letter. A
row without a doc_id is kept as any other; rows equal in doc_id and text are copies, of which one stays, and ties go to the least key, then the least hash of the
text. A very long text is one slice in every stage and is never cut short. A document that held nothing but benchmark passages stays with what is left of it. An empty table gives an empty
table with the same columns. Columns beyond doc_id, text, lang, source and n_chars go along; one that has the name of a result of the last
stage comes back as source_<name>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard_join, language_id, mixing, sharding
from tidemark.llm.common import read, stored


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected."""
    return language_id.drop_rejected(docs, language_id.learn(language_id.training_rows(docs)))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the least doc_id."""
    return jaccard_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark passages that they held; n_chars follows the text."""
    clean = decontamination.remove_spans(docs, read(spark, sf_dir, "benchmark"))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say."""
    return mixing.apply_rates(docs, mixing.mixed(docs, mixing.domains_of(read(spark, sf_dir, "labels")), mixing.TARGETS))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot."""
    return sharding.shard(docs, keep=[c for c in docs.columns if c != "doc_id"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("near_copies", near_copy_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Compression and MinHash are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again before the next."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
