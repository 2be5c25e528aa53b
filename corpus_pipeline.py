"""From raw documents to a clean corpus: quality, duplicates, test-set leaks, token ids.

Each stage reads what the stage before it wrote, works on all of its rows, and
passes on whole documents with all their columns; the last one encodes them.

NULL and empty texts fail the base quality rules and leave at the first stage;
an empty table stays empty through all stages.  The duplicate stage keeps
exactly one row of each group of near copies, so one row of each id too; a row
without an id is a document of its own, known by its text.  All other stages
decide row by row and never look at ids.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haltwerk.llm import decontaminate, minmax_dedup, quality_classifier, quality_rules, scratch, viterbi

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or that the label model finds bad."""
    return quality_rules.good(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the trained scorer rejects."""
    return quality_classifier.good(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies: that of the least id, a row without an id only if no other is there.

    Of rows with that id it is the one with the least hash, whichever columns differ.
    """
    unnamed = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2)  # beyond the ids in use
    keyed = docs.withColumn("_row", F.coalesce(F.col("doc_id").cast("bigint"), unnamed))
    verdict = minmax_dedup.near_duplicates(keyed, SHINGLE_WORDS, SIMILAR_PERCENT, id_column="_row")
    kept = verdict.where("kept").select(F.col("doc_id").alias("_row")).distinct()
    # repeated rows combine before they are shuffled
    one = keyed.groupBy("_row").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_one"))
    return one.join(kept, "_row", "left_semi").select("_one.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, copied or edited."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left: doc_id, ids, n_tokens, and whether decoding gives the text back."""
    return viterbi.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

# Label models, trained scorers and alignments are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
