"""A training-corpus pipeline over ``documents``: five stages, each written as Parquet and read by the next.

1. ``quality``: documents that the quality classifier rejects go;
2. ``near_duplicates``: one document of each near-duplicate group stays;
3. ``repeats``: byte strings that also start earlier in what is left are removed from the texts;
4. ``decontamination``: documents that hold a benchmark item go;
5. ``tokens``: the rest is encoded and decoded; the result has the digests of ids and decoded texts.

Stages 1-4 return the columns of ``documents``. Defined results: rows without a doc_id are never grouped,
shortened against their own kind as first rows, and never contaminated, so they stay; rows that repeat a
doc_id stay or go together at stages 2 and 4; empty tables give empty results; further columns pass through
stages 1-4 unchanged (n_chars follows a shortened text).
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spanwise.llm import bpe_segment_tree, minhash_circulant, quality_qda, suffix_dedup, template_decontamination
from spanwise.llm.common import small_batches, table
from spanwise.session import keep


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut; the classifier learns from the labels of these documents."""
    small_batches(spark)
    model = quality_qda.fit(quality_qda.features(docs), table(spark, sf_dir, "labels"))
    return quality_qda.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group."""
    small_batches(spark)
    gone = minhash_circulant.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the byte strings that also start earlier."""
    small_batches(spark)
    return suffix_dedup.without_repeats(docs, suffix_dedup.repeats(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    return template_decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document left."""
    small_batches(spark)
    return bpe_segment_tree.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("decontamination", decontamination), ("tokens", tokens),
]

#: The classifier, the component search and the tokenizer are beyond SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
