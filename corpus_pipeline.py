"""Corpus pipeline: toxicity, near-duplicates, decontamination, mixing, token files."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from postloom.llm import decontaminate, jaccard, mixing, simhash, token_files, toxicity
from postloom.storage import drop, stored_alone


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays.

    Groups are those of SimHash fingerprints (operator 8: three words, three bits), joined by the links that it misses:
    a Jaccard similarity of 0.8 or more over five-word shingles.
    """
    return jaccard.drop_near_duplicates(docs, also=simhash.component_links(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they hold for each document."""
    return token_files.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("mix", mix),
    ("encode", encode),
]

#: SQL can express neither the toxicity votes nor the string tiling.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and read again by the next.

    What a stage wrote on its way goes once its result is written, that result once the next one is. Those of
    the last stage stay, as its rows are read later.
    """
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, now = stored_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        if path:
            drop(spark, [path])
        path = now
    return STAGES[-1][1](spark, docs, sf_dir)
