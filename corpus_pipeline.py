"""From raw documents to token ids: filter, one of each near copy, no benchmark text, no secrets, ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenland.llm import decontamination, jaccard_join, piece_tokens, quality, secrets
from fenland.llm.common import read
from fenland.sources.scratch import shared_folder

TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.7 or more, null and empty texts scored like any other."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"), threshold=0.7)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id."""
    return jaccard_join.keep_one(docs, threshold=0.8, words=5)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by `[secret]`; n_chars follows the text."""
    cleaned = secrets.redact(docs)
    return cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (with an end id), decoded text of every document."""
    return piece_tokens.encode_documents(docs, TOKENIZER)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("benchmark decontamination", benchmark_stage),
    ("secret scans", secret_stage),
    ("SentencePiece encoding and decoding", token_stage),
]

# merge-type ids, learned scores and edit distances are beyond SQL; tests/llm holds the stages to brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over `documents`; the stages' tables lie under the shared checkpoint folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
