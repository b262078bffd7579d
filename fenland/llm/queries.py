"""The operators over their whole tables with production parameters, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fenland.llm import (
    decontamination,
    html_extract,
    jaccard_join,
    lm_score,
    manifest,
    periodic_runs,
    personal_data,
    piece_tokens,
    quality,
    secrets,
    sharding,
    token_counts,
    vector_dedup,
)
from fenland.llm.common import read
from fenland.llm.sql_twins import OP3_SQL, OP5_SQL, OP6_SQL, OP11_SQL, OP13_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_quality_score")
def op1_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels of three quarters of the ids."""
    return quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.7)


@query("op2_html_main_text")
def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(read(spark, sf_dir, "pages"))


@query("op3_secret_scan", OP3_SQL)
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secrets.secret_digests(read(spark, sf_dir, "documents"))


@query("op4_ngram_jaccard_join")
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of the documents whose word five-grams have Jaccard 0.8 or more."""
    found = jaccard_join.near_copies(read(spark, sf_dir, "documents"), threshold=0.8, words=5)
    return found.drop("text_key")


@query("op5_embedding_near_dedup", OP5_SQL)
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of the vectors with cosine 0.95 or more."""
    return vector_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.95)


@query("op6_feistel_sharding", OP6_SQL)
def op6_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard (0 to 39) and slot under the law `rows`."""
    return sharding.assign_shards(read(spark, sf_dir, "documents"), shards=40)


@query("op7_piece_round_trip")
def op7_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's piece ids and of the text they decode to."""
    return piece_tokens.digest_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op8_prefix_token_counts")
def op8_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, and how much of it 512 tokens hold."""
    return token_counts.count_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


@query("op9_maxent_lm_score")
def op9_maxent_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document, with the unigram score as base."""
    return lm_score.score_documents(read(spark, sf_dir, "documents"))


@query("op10_edit_decontamination")
def op10_edit_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that each document holds within the error budget."""
    return decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op11_merkle_manifest", OP11_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and the root that its tampered leaf leads to."""
    return manifest.tamper_report(read(spark, sf_dir, "documents"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated stretches of every document; every tenth id repeats a stretch of its words up to its end first."""
    return periodic_runs.run_digests(read(spark, sf_dir, "documents"), edit=periodic_runs.with_repeats)


@query("op13_personal_data", OP13_SQL)
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return personal_data.personal_digests(read(spark, sf_dir, "documents"))
