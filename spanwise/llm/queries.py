"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.llm import bpe_segment_tree, language_hd, license_minhash, minhash_circulant, periodic_runs, phrase_mining, quality_qda, quality_sketch, source_mix, suffix_dedup, template_decontamination, token_files, toxicity_kn
from spanwise.llm.common import small_batches, table
from spanwise.session import keep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op7_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: doc_id, held_out, score, predicted."""
    small_batches(spark)
    vectors = keep(quality_qda.features(table(spark, sf_dir, "documents")), "op7-features")
    return quality_qda.score(vectors, quality_qda.fit(vectors, table(spark, sf_dir, "labels")))


@query
def op6_minhash_circulant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents: doc_id, n_shingles, component_id, kept."""
    small_batches(spark)
    return minhash_circulant.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op9_bpe_segment_tree(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Ids of every document and back: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    small_batches(spark)
    return bpe_segment_tree.digests(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_50k.json"))


@query
def op2_quality_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive quality rules on every document: base counts, base_failed, kept, broken rules."""
    small_batches(spark)
    return quality_sketch.quality_rules(table(spark, sf_dir, "documents"))


@query
def op4_language_hd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: doc_id, held_out, lang_pred, score, margin."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return language_hd.predict(docs, *language_hd.prototypes(docs))


@query
def op8_toxicity_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score, evidence, predicted."""
    small_batches(spark)
    return toxicity_kn.fit_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_token_files(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Token-id files of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    small_batches(spark)
    vocabulary = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    parts = token_files.finish(token_files.write(table(spark, sf_dir, "documents"), vocabulary))
    return token_files.checksums(parts, vocabulary)


@query
def op5_license_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document: doc_id, template, n_shared, n_template, containment."""
    return license_minhash.scan(table(spark, sf_dir, "documents"))


ORACLES["op5_license_minhash"] = license_minhash.oracle()


@query
def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items: doc_id, item_id, n_windows, item_windows, coverage, kind."""
    small_batches(spark)
    return template_decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat earlier ones: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.spans(docs, suffix_dedup.repeats(docs))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document: n_runs, the strongest one, digests of all runs and of the collapsed text."""
    small_batches(spark)
    found = periodic_runs.runs(periodic_runs.with_planted_periods(table(spark, sf_dir, "documents")))
    best = found.withColumn("best", periodic_runs.strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periodic_runs.listing(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document: doc_id, size, source_size, target, taken."""
    return source_mix.mix(table(spark, sf_dir, "documents")).drop("source", "copies")


ORACLES["op11_source_mix"] = source_mix.oracle()


@query
def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of every language: lang, rank, phrase, a, l, r, n, score."""
    small_batches(spark)
    return phrase_mining.phrases(table(spark, sf_dir, "documents"))


ORACLES["op12_phrase_mining"] = phrase_mining.oracle()
