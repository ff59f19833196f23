"""A corpus pipeline: toxicity, language, near duplicates, benchmark passages, tokens.

Every stage takes all that its predecessor kept.  All but the last return the columns of documents, whatever further
ones there are, and an empty table where they get one.  Texts of any length are handled whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import byte_bpe, decontaminate, jaccard_join, language_id, toxicity
from wordloom.llm.shared import fold_of, materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more as toxic go; the scorer learns from the labels outside the held-out fold.

    Null and empty texts are not toxic; repeated rows are each kept or dropped; without labels nothing goes; a null id
    has no label.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold_of(F.col("doc_id")) != 0)
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be determined go: null texts, texts without a letter, and those of no language by half.

    Rows with a null language are not learned from; ties go to the language that sorts first, and are no half; repeated
    rows are each kept or dropped.
    """
    return language_id.with_language(docs, language_id.fit(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at 0.8 or more, the one with the smallest id stays.

    Texts without words link with nothing and stay; of rows with one id and text one stays; rows without an id stay.
    """
    return jaccard_join.one_of_each(docs, 5, 4, 5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; null texts and an empty benchmark leave all; repeated rows go together."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as little-endian unsigned 32-bit integers, and their hash; null texts have none; rows repeat."""
    out = byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("jaccard_join", one_of_near_copies),
    ("decontaminate", drop_leaks),
    ("byte_bpe", encode),
]

#: The stages learn models and search for edited passages, which SQL can't express; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
