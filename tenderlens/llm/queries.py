"""One query per operator over the whole tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenderlens.llm import (
    chat, decontaminate, html, imatch, jaccard, lengths, licenses, pieces, quality, spelling,
    suffixes, warc, whitening)
from tenderlens.llm.texts import bounded_batches


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file, which every machine of the cluster holds."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"),
                               table(spark, folder, "benchmark"))


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digests(table(spark, folder, "documents"), tokenizer("piece_bpe_32k.model"))


def op3_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.main_text(table(spark, folder, "pages"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"))


def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(table(spark, folder, "documents"))


def op6_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar(table(spark, folder, "documents"), width=4, percent=85)


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages")).select(
        "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return lengths.token_counts(table(spark, folder, "documents"),
                                tokenizer("piece_bpe_32k.model"))


def op9_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
        "conv_id long, turn long, role string, text string")
    return chat.format_digests(turns.unionByName(extra), tokenizer("byte_bpe_50k.json")).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op10_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.digests(table(spark, folder, "documents"))


def op11_imatch(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.fingerprints(table(spark, folder, "documents"))


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_main_text": op3_main_text,
    "op4_quality": op4_quality,
    "op5_licenses": op5_licenses,
    "op6_jaccard": op6_jaccard,
    "op7_warc": op7_warc,
    "op8_token_counts": op8_token_counts,
    "op9_chat": op9_chat,
    "op10_suffixes": op10_suffixes,
    "op11_imatch": op11_imatch,
    "op12_spelling": op12_spelling,
    "op13_whitening": op13_whitening,
}

ORACLE = {
    "op4_quality": quality.SQL,
    "op7_warc": warc.SQL,
    "op9_chat": chat.SQL,
    "op11_imatch": imatch.SQL,
}
