"""A training-corpus pipeline: five stages over documents, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, langid, mixing, pii, simhash
from millrace.llm.runtime import Scratch, scratches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Near copies: words of a shingle, differing bits that make a candidate (as a common band does), and the least similarity of the shingle sets.
SHINGLE, BITS, SIMILARITY = 5, 4, 0.8

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language can be told; fills in missing languages."""
    return langid.keep_identified(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id of each near-duplicate group."""
    return simhash.keep_first(spark, docs, SHINGLE, BITS, SIMILARITY)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data."""
    return pii.masked(spark, docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that sources have their target weights."""
    return mixing.mixed(spark, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mixed documents."""
    path = str(public_tokenizers.path(VOCABULARY))
    return bpe.encode_digests(spark, docs, path, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("private_data", private_data),
    ("mixture", mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each stage's rows are written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratches(keep_results=True):
        scratch, before = Scratch(spark, "pipeline"), None
        for name, stage in STAGES:
            with scratches():
                docs = scratch.save(stage(spark, docs, sf_dir), name)
            if before:
                scratch.drop(before)
            before = name
        return scratch.finish(docs)


#: SQL can't express the fingerprints, the trained models, the draw or the tokens.
ORACLE_SQL: str | None = None
