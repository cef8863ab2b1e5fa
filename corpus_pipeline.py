"""The corpus pipeline: quality rules, exact and near deduplication, privacy, packing.

Each stage takes (spark, docs, sf_dir) and gets what its predecessor kept,
written as Parquet and read again. All but the last return the columns of
documents, whatever these are called. Packing has no SQL equivalent, so tests
hold the whole against a brute-force version.

Defined cases of every stage: an empty table gives an empty result; repeated rows
are each judged (quality, privacy, packing) or reduced to one (deduplication); rows
without a ``doc_id`` are judged by their own texts; very long texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import exact_dedup, near_dedup, packing, privacy, quality_rules
from lorekeep.llm.names import unused
from lorekeep.storage import load, materialise, ship


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts fail them; a
    document whose score is the threshold stays."""
    rules = unused("__rules", docs.columns)
    return quality_rules.quality_rules(docs, load(spark, sf_dir, "labels"), rules=rules).where(F.col(f"{rules}.kept")).drop(rules)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the least ``doc_id``, nulls
    last; null and empty texts are one group."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8), that of the
    least ``doc_id``; texts without words all stay."""
    return near_dedup.keep_representatives(docs, size=5, percent=80)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; ``n_chars`` follows the new text. Null
    texts stay null."""
    entities = unused("__entities", docs.columns)
    out = privacy.surrogates(docs, entities=entities).drop(entities)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, as ``op8_packing`` returns them; a null or empty text is
    its end id alone, and documents of one curve key are ordered by ``doc_id``."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("privacy", replace_private),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
