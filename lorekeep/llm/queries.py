"""The registered queries of the training-data operators: production parameters,
whole tables, the columns that their contracts name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import backoff_scores, byte_pairs, exact_dedup, hard_negatives, near_dedup, packing, privacy, quality_classifier, quality_rules, ranked_search, sentence_pieces, suffix_dedup, toxicity
from lorekeep.llm.oracles import ORACLES
from lorekeep.storage import load


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), keep=["doc_id"])
    return out.select("doc_id", *[F.col(f"__rules.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")])


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(load(spark, sf_dir, "documents"))


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_digests(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(load(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op5_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores.backoff_scores(load(spark, sf_dir, "documents"))


def op6_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = privacy.surrogates(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.size("__entities").cast("long").alias("n_entities"), F.col("__entities").alias("entities"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents"), size=3, percent=85)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(load(spark, sf_dir, "embeddings"), F.col("key") % 100 == 0, label=label)


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.encode_digests(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(load(spark, sf_dir, "benchmark"), load(spark, sf_dir, "documents"), limit=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_exact_dedup,
        op3_suffix_dedup,
        op4_quality_classifier,
        op5_backoff_scores,
        op6_privacy,
        op7_near_dedup,
        op8_packing,
        op9_sentence_pieces,
        op10_toxicity,
        op11_hard_negatives,
        op12_byte_pairs,
        op13_ranked_search,
    )
}

__all__ = ["QUERIES", "ORACLES"]
