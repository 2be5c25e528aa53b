"""Registered queries of the operators in this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haltwerk.llm import (
    decontaminate,
    deleted_interpolation,
    filter_audit,
    html_content,
    minmax_dedup,
    quality_classifier,
    quality_rules,
    scratch,
    separator_scan,
    spelling_variants,
    suffix_dedup,
    token_files,
    toxicity_chain,
    viterbi,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_deleted_interpolation(spark: SparkSession, folder: str) -> DataFrame:
    return deleted_interpolation.score(table(spark, folder, "documents"))


@query
def op2_seed_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op3_streaming_viterbi(spark: SparkSession, folder: str) -> DataFrame:
    rows = viterbi.encoded(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_tokens", "ids", "same")


@query
def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.classify(table(spark, folder, "documents"))


@query
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality_rules.apply_rules(table(spark, folder, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "good_probability"
    )


@query
def op7_minmax_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minmax_dedup.near_duplicates(table(spark, folder, "documents"))


@query
def op6_html_content(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html_content.extract(pages, html_content.fitted(pages))


@query
def op8_separator_scan(spark: SparkSession, folder: str) -> DataFrame:
    end = 50256
    streams = separator_scan.flat(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end)
    streams = scratch.written(streams, "streams")
    return separator_scan.named(separator_scan.scan(streams, end), streams).select("doc_id", "file", "ordinal", "start", "n_tokens")


# fixed values: what the labels call toxic, told apart by kind
NAME_CALLING = "idiot|moron|loser|clown|scum"
CONTEMPT = "stupid|pathetic|worthless|disgusting|trash"


@query
def op9_toxicity_chain(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    kinds = {"name_calling": NAME_CALLING, "contempt": CONTEMPT}
    derived = {k: (F.col("toxic") == 1) & F.col("text").rlike(rf"(?i)\b({words})\b") for k, words in kinds.items()}
    chain = toxicity_chain.fit(docs, table(spark, folder, "labels"), (*kinds, "toxic"), derived)
    return toxicity_chain.score(docs, chain)


@query
def op10_mixing_coder(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch.folder(spark, "token-files")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    token_files.write(table(spark, folder, "documents"), path, tokenizer, end_id=2, alphabet=49408)
    return token_files.digest(spark.read.parquet(path)).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op11_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = suffix_dedup.dedup(table(spark, folder, "documents"))
    return rows.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = spelling_variants.counted_words(table(spark, folder, "documents"))
    return spelling_variants.variants(words)


@query
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


ORACLE_SQL["op13_filter_audit"] = filter_audit.SQL
