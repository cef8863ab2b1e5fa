"""Lexical indexes of the documents, each written once a session and table folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import lexical
from lorekeep.operators.lexical_index import LexicalIndex
from lorekeep.storage import load, new_path, spread

_written: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, d: str, name: str, write: Callable[[str], LexicalIndex]) -> LexicalIndex:
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _written:
        path = new_path(spark, name)
        write(path)
        _written[key] = path
    return LexicalIndex.open(spark, _written[key])


def document_index(spark: SparkSession, d: str) -> LexicalIndex:
    return _stored(spark, d, "document-index", lambda path: lexical.write_bm25_index(spread(load(spark, d, "documents")), "doc_id", path))


def page_index(spark: SparkSession, d: str) -> LexicalIndex:
    """Documents as pages."""
    pages = spread(load(spark, d, "documents")).selectExpr("doc_id AS id", "source || '/' || lang || '_' || doc_id AS path", "source AS title", "lang || ' ' || source AS description", "text AS content")
    return _stored(spark, d, "page-index", lambda path: lexical.write_field_index(lexical.page_units(pages), lexical.PAGE_SCORES, path))


def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the documents as chunks."""
    lines = spread(load(spark, d, "documents")).select(F.col("doc_id").alias("article_id"), F.col("source").alias("path"), F.col("lang").alias("heading"), F.posexplode(F.split(T.text_or_empty(F.col("text")), "\n")).alias("p", "body"))
    return lines.select("article_id", "path", F.col("p").cast("long").alias("ordinal"), "heading", "body")


def chunk_index(spark: SparkSession, d: str) -> LexicalIndex:
    return _stored(spark, d, "chunk-index", lambda path: lexical.write_field_index(lexical.chunk_units(line_chunks(spark, d)), lexical.CHUNK_SCORES, path))
