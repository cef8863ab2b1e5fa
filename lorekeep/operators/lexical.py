"""Lexical retrieval: BM25, weighted field scores, Jaccard search.

Queries are a table too, so many questions run in one job. BM25 and field scores
search an index that is written once (see ``lexical_index``) and read only where a
query's best may be; the search for the most similar token sets scores documents where
they are read (see ``term_search``). Corpus statistics are aggregated before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import term_search
from lorekeep.operators.lexical_index import SLACK, LexicalIndex, candidates, number_units, postings, write_postings
from lorekeep.storage import materialise, new_path, ship

K1, B = 1.2, 0.75
PAGE_LEAD, PAGE_LONG, CHUNK_LONG, MAX_PAGE_SCORE = 500, 1500, 1200, 6.45


def term_counts(docs: DataFrame, key: str, text: str, tokenize: Callable[[Column], Column] = T.tokens) -> DataFrame:
    """(key, term, tf, length): each document's terms with its token count."""
    listed = docs.select(key, tokenize(F.col(text)).alias("__t"))
    return listed.select(key, F.size("__t").alias("length"), F.explode("__t").alias("term")).groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_statistics(docs: DataFrame, text: str, tokenize: Callable[[Column], Column] = T.tokens) -> DataFrame:
    """One row: number of documents and their average token count."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size(tokenize(F.col(text)))), F.lit(0.0)).alias("avg_length"))


def write_bm25_index(docs: DataFrame, key: str, path: str, text: str = "text", k1: float = K1, b: float = B, tokenize: Callable[[Column], Column] = T.tokens) -> LexicalIndex:
    """Writes the index of ``docs``: (key, length) of each, and BM25's share of each term
    without its rarity, which a search weighs."""
    terms = tokenize(F.col(text))
    units = number_units(docs.select(F.col(key), terms.alias("terms")).select(key, F.size("terms").alias("length"), "terms"), path)
    average = units.agg(F.coalesce(F.avg("length"), F.lit(0.0))).first()[0] or 1.0
    value = lambda tf, length: tf[0] * (k1 + 1) / (tf[0] + k1 * (1 - b + b * length / average))
    return LexicalIndex(units, write_postings(postings(units.select("unit", "length", "terms"), "length", [F.col("terms")], value), path))


def search_bm25(queries: DataFrame, index: LexicalIndex, query_key: str, key: str, limit: int, query_text: str = "text", tokenize: Callable[[Column], Column] = T.tokens) -> DataFrame:
    """The ``limit`` best documents of each query: (query, key, score, rank).
    Distinct query terms count once; ties go to the smaller key."""
    n = index.units.count()
    found = candidates(index, queries, query_key, tokenize(F.col(query_text)), limit, weigh=lambda df: np.log(1 + (n - df + 0.5) / (df + 0.5)))
    scored = found.join(index.units.select("unit", key), "unit").select(query_key, key, F.round("total", 6).alias("score")).where("score > 0")
    return top_by_group(scored, [query_key], [F.col("score").desc(), F.col(key)], limit)


def bm25(queries: DataFrame, docs: DataFrame, query_key: str, key: str, limit: int, query_text: str = "text", text: str = "text", k1: float = K1, b: float = B, tokenize: Callable[[Column], Column] = T.tokens) -> DataFrame:
    """``search_bm25`` over an index written for this search alone."""
    index = write_bm25_index(docs, key, new_path(docs.sparkSession, "bm25-index"), text, k1, b, tokenize)
    return search_bm25(queries, index, query_key, key, limit, query_text, tokenize)


def top_by_group(scored: DataFrame, group: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group, with their ``rank`` from 1."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= limit)


def best_jaccard(queries: DataFrame, docs: DataFrame, query_key: str, key: str, query_text: str = "text", text: str = "text", limit: int = 1) -> DataFrame:
    """The documents most similar to each query by token sets: (query, key, jaccard, rank)."""
    def rate(hits, sizes, batch):
        nd = batch.column(1).to_numpy()[:, None]
        j = hits[0] / np.maximum(sizes[None, :] + nd - hits[0], 1)
        return j, j

    asked = T.token_set(F.col(query_text))
    held = docs.select(F.col(key), T.token_set(F.col(text)).alias("__d"))
    found = term_search.candidates(queries, query_key, asked, held, {key: F.col(key), "nd": F.size("__d")}, {"shared": F.col("__d")}, limit, rate)
    sized = found.join(queries.select(query_key, F.size(asked).alias("nq")), query_key)
    scored = sized.select(query_key, key, F.round(F.col("shared") / (F.col("nq") + F.col("nd") - F.col("shared")), 6).alias("jaccard"))
    return top_by_group(scored, [query_key], [F.col("jaccard").desc(), F.col(key)], limit)


@dataclass(frozen=True)
class FieldScores:
    """Weights of fields, of exact hits and of the order of terms. Units have a column of
    each field and their ``penalty`` (at most 1); the full text is the fields, one below another."""

    fields: dict[str, float]
    exact: float
    phrase: float = 0.25


PAGE_SCORES = FieldScores({"f_path": 2.2, "f_title": 2.0, "f_description": 1.0, "f_body": 0.6}, 0.4)
CHUNK_SCORES = FieldScores({"f_path": 1.5, "f_heading": 2.3, "f_body": 1.0}, 0.35)


def write_field_index(units: DataFrame, scores: FieldScores, path: str) -> LexicalIndex:
    """Writes the index of ``units(keys, fields, penalty)``: the words of each field, what each term
    adds to a unit's score, and the penalties."""
    numbered = number_units(units.select(*(T.words_of(F.col(c)).alias(c) if c in scores.fields else c for c in units.columns)), path)
    weights = list(scores.fields.values())
    value = lambda held, penalty: (sum((w * (n > 0) for w, n in zip(weights, held)), scores.exact)) * penalty
    lists = [F.split(f, " ") for f in scores.fields]
    made = postings(numbered.select("unit", "penalty", *scores.fields), "penalty", lists, value, own=True, keep=T.is_token(F.col("term")))
    return LexicalIndex(numbered, write_postings(made, path))


def search_fields(queries: DataFrame, index: LexicalIndex, query_key: str, keys: list[str], scores: FieldScores, limit: int, query_text: str = "text") -> DataFrame:
    """(query, *keys, score) of units that share a token with a query, the ``limit`` best
    of each query among them: the weighted coverage of each field, plus exact hits and the
    phrase bonus over the full text, times the penalty."""
    asked = T.token_set(F.col(query_text))
    questions = queries.select(query_key, asked.alias("__q"))
    found = materialise(candidates(index, queries, query_key, asked, limit, scores.phrase), "candidates")
    # The order of terms needs the text. It is looked up only for units that could still be
    # among the best: whose score with a full bonus reaches the least of the best without one.
    bars = top_by_group(found.select(query_key, "low", "unit"), [query_key], [F.col("low").desc(), F.col("unit")], limit).groupBy(query_key).agg(F.min("low").alias("bar"))
    rivals = found.select(query_key, "unit", "high").join(F.broadcast(bars), query_key).where(F.col("high") >= F.col("bar") - SLACK).select(query_key, "unit")
    rivals = rivals.join(index.units, "unit").join(questions, query_key)
    # Sums of the index may differ from the formula's in the last digit.
    ship(queries.sparkSession)
    kept = rivals.select(query_key, *keys).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    scored = rivals.select(query_key, *keys, "unit", "__q", "penalty", *scores.fields).mapInArrow(_field_scores(scores, len(kept)), f"{kinds}, score double")
    return scored.withColumn("score", F.round("score", 6)).where("score > 0")


def _field_scores(scores: FieldScores, carried: int):
    """Scores of rows (carried columns, unit, the query's tokens, penalty, words of each field)."""

    def run(batches):
        for b in batches:
            queries, units, penalties = (b.column(i).to_pylist() for i in (0, carried, carried + 2))
            fields, tokens, last, out = b.columns[carried + 3 :], {}, None, np.zeros(b.num_rows)
            for i, (query, unit, penalty) in enumerate(zip(queries, units, penalties)):
                if unit != last:  # rows come by unit
                    words = [f[i].as_py() or "" for f in fields]
                    held, full = [set(w.split(" ")) for w in words], " ".join(w for w in words if w)
                    last, every = unit, set().union(*held)
                q = tokens.get(query) or tokens.setdefault(query, b.column(carried + 1)[i].as_py())
                # Matched tokens in the query's order.
                matched = [t for t in q if t in every]
                share, near = len(matched) / len(q), 0.0
                if len(matched) > 1:
                    near = 1.0 if any(f"{x} {y}" in full for x, y in zip(matched, matched[1:])) else min(0.75, share)
                base = 0.0
                for h, w in zip(held, scores.fields.values()):
                    base += len(h.intersection(matched)) / len(q) * w
                out[i] = (base + share * scores.exact + near * scores.phrase) * penalty
            yield pa.RecordBatch.from_arrays([*b.columns[:carried], pa.array(out)], [*b.schema.names[:carried], "score"])

    return run


def page_units(pages: DataFrame) -> DataFrame:
    """Units of ``pages(id, path, title, description, content)``."""
    body = F.substring(T.without_frontmatter_and_title(F.col("content")), 1, PAGE_LEAD)
    described = T.text_or_empty(F.col("description"))
    fields = {"f_path": F.col("path"), "f_title": F.col("title"), "f_description": described, "f_body": body}
    return pages.select("id", "path", *(c.alias(n) for n, c in fields.items()), T.length_penalty(F.length(described), PAGE_LONG, 0.55).cast("double").alias("penalty"))


def chunk_units(chunks: DataFrame) -> DataFrame:
    """Units of ``chunks(article_id, path, heading, body, ordinal)``; blank ones are none."""
    heading, body = T.text_or_empty(F.col("heading")), T.text_or_empty(F.col("body"))
    live = chunks.where(body.rlike(r"\S"))
    fields = {"f_path": F.col("path"), "f_heading": heading, "f_body": body}
    return live.select("article_id", "path", "ordinal", "heading", *(c.alias(n) for n, c in fields.items()), T.length_penalty(F.length(body), CHUNK_LONG, 0.5).cast("double").alias("penalty"))


def search_pages(queries: DataFrame, index: LexicalIndex, query_key: str, limit: int, query_text: str = "text") -> DataFrame:
    scored = search_fields(queries, index, query_key, ["id", "path"], PAGE_SCORES, limit, query_text)
    return top_by_group(scored, [query_key], [F.col("score").desc(), F.col("id"), F.col("path")], limit)


def search_chunks(queries: DataFrame, index: LexicalIndex, query_key: str, limit: int, query_text: str = "text") -> DataFrame:
    scored = search_fields(queries, index, query_key, ["article_id", "path", "ordinal", "heading"], CHUNK_SCORES, limit, query_text)
    return top_by_group(scored, [query_key], [F.col("score").desc(), F.col("article_id"), F.col("path"), F.col("ordinal"), F.col("heading")], limit)


def lexical_pages(queries: DataFrame, pages: DataFrame, query_key: str, limit: int, query_text: str = "text") -> DataFrame:
    """Best pages of ``pages(id, path, title, description, content)`` for each query."""
    return search_pages(queries, write_field_index(page_units(pages), PAGE_SCORES, new_path(pages.sparkSession, "page-index")), query_key, limit, query_text)


def lexical_chunks(queries: DataFrame, chunks: DataFrame, query_key: str, limit: int, query_text: str = "text") -> DataFrame:
    """Best chunks of ``chunks(article_id, path, heading, body, ordinal)`` for each query."""
    return search_chunks(queries, write_field_index(chunk_units(chunks), CHUNK_SCORES, new_path(chunks.sparkSession, "chunk-index")), query_key, limit, query_text)


def normalised_page_score(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / MAX_PAGE_SCORE))


def select_seeds(queries: DataFrame, pages: DataFrame, query_key: str, top_k: int = 5, min_score: float = 0.1, query_text: str = "text") -> DataFrame:
    """Seed pages of each query: normalised page score of id, description and lead."""
    keywords = F.regexp_replace(F.regexp_extract(F.regexp_extract("content", r"\A---\n(?s:(.*?))\n---", 1), r"wiki_keywords:\s*\[(.*?)\]", 1), "['\",]", " ")
    described = F.concat_ws("\n", F.nullif(T.text_or_empty(F.col("description")), F.lit("")), F.nullif(F.lower(F.trim(keywords)), F.lit("")))
    body = F.substring(T.without_frontmatter(F.col("content")), 1, PAGE_LEAD)
    seeds = page_units(pages.select("id", F.col("id").alias("path"), F.col("id").alias("title"), described.alias("description"), body.alias("content")))
    index = write_field_index(seeds, PAGE_SCORES, new_path(pages.sparkSession, "seed-index"))
    scored = search_fields(queries, index, query_key, ["id"], PAGE_SCORES, top_k, query_text)
    scored = scored.withColumn("score", F.round(normalised_page_score(F.col("score")), 6)).where(F.col("score") >= min_score)
    return top_by_group(scored, [query_key], [F.col("score").desc(), F.col("id")], top_k)
