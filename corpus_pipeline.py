"""A training corpus from ``documents``: quality rules, near duplicates, repeated passages,
benchmark leaks, token ids. Each stage is written to the shared folder and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenderlens.llm import decontaminate, jaccard, pieces, quality, suffixes
from tenderlens.llm.queries import table, tokenizer
from tenderlens.sources.staging import shared_folder

# Near duplicates: shingles of five words, similarity from 0.8 on.
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail; n_chars follows."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that with the least id, unchanged."""
    return jaccard.representatives(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without bytes that repeat a document with a smaller id; n_chars follows."""
    return suffixes.deduplicated(docs).withColumn("n_chars", F.length("text").cast("long"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item, unchanged."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the token ids and digest of the decoded text of every document."""
    return pieces.digests(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", good_quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding and decoding", token_ids),
]

# Suffix arrays and merge rules have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, step) in enumerate(STAGES):
        out = step(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
