"""Queries of this subpackage's operators over the given tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filter_audit, html_text, language, metric_join, mixing, mtree, pii, prefix_trie, simhash, token_counts, token_files, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and evidence of every document."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 vectors of largest inner product for every fiftieth vector."""
    return mtree.top_k(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 50 == 0, k=5)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language.predict_languages(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal data replaced by format-preserving pseudonyms."""
    docs = table(spark, sf_dir, "documents")
    return pii.pseudonymize(docs, key="a key from a secret store goes here").select("doc_id", "text", "pii")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systematic sampling of all documents to source weights 5, 2, 1 and 150 % of all words."""
    return mixing.mixture_copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written as token files and read back from them."""
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that is found in it."""
    return decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct beginning of the rebuilt conversations, with the totals of its subtree."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source in each of their orders."""
    return filter_audit.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every document, by links of Jaccard similarity 0.85 or more over four-word shingles."""
    return metric_join.jaccard_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_mtree": op2_mtree,
    "op3_language": op3_language,
    "op4_pii": op4_pii,
    "op5_mixing": op5_mixing,
    "op6_token_files": op6_token_files,
    "op7_token_counts": op7_token_counts,
    "op8_simhash": op8_simhash,
    "op9_html_text": op9_html_text,
    "op10_decontamination": op10_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_filter_audit": op12_filter_audit,
    "op13_metric_join": op13_metric_join,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mtree": mtree.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
}
