"""Vector similarity: cosine search, pooled scores, floors.

Searches take a stated query set, whose size is checked before it is broadcast, against all rows in
Arrow blocks; each block keeps its best rows only. Joins are in ``similarity_join``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.storage import ship

#: Bytes of query vectors that are broadcast at once; more go in several rounds.
BROADCAST_BYTES = 64 << 20
#: Queries that a block of rows is compared with at once, and rows of it where every score is kept.
SLICE, TILE = 256, 1024


def usable(vector: Column, dimensions: int | None = None) -> Column:
    """Non-empty, of the right size, all finite."""
    ok = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(ok & (F.size(vector) == dimensions) if dimensions else ok, F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _rounds(queries: DataFrame, dims: int, most: int | None = None):
    """Broadcasts of (ids, unit vectors, further columns), each of at most ``BROADCAST_BYTES`` of vectors
    and ``most`` queries; the driver holds the rows of one round at a time."""
    sc = queries.sparkSession.sparkContext
    per_round = max(1, min(BROADCAST_BYTES // (8 * dims), most or BROADCAST_BYTES))
    part = []

    def held():
        ids, vectors, *more = zip(*part)
        return sc.broadcast((np.array(ids), unit(np.array(vectors, np.float64).reshape(len(ids), dims)), *more))

    for r in queries.toLocalIterator():
        part.append(r)
        if len(part) == per_round:
            yield held()
            part = []
    if part:
        yield held()


def asked(queries: DataFrame, id_: str, vector: str) -> tuple[DataFrame, int]:
    """``queries(id, vector)`` of the longest usable size, and that size."""
    good = queries.select(id_, vector).where(usable(F.col(vector)))
    dims = good.agg(F.max(F.size(vector))).first()[0] or 1
    return good.where(F.size(vector) == dims), dims


def in_rounds(queries: DataFrame, source: DataFrame, dims: int, scorer, schema: str, most: int | None = None) -> DataFrame:
    """``source`` scored in Arrow blocks against each round of ``queries(id, vector, ...)``."""
    out = None
    for held in _rounds(queries, dims, most):
        found = source.mapInArrow(scorer(held), schema)
        out = found if out is None else out.unionByName(found)
    return source.sparkSession.createDataFrame([], schema) if out is None else out


def _against(queries: DataFrame, vectors: DataFrame, id_: str, vector: str, group: str, scorer, columns: str) -> DataFrame:
    """``vectors(id, vector, group)`` scored in Arrow blocks against each round of the queries."""
    ship(vectors.sparkSession)
    rows, dims = asked(queries, id_, vector)
    source = vectors.where(usable(F.col(vector), dims)).select(F.col(id_).alias("__id"), F.col(vector).alias("__vector"), F.col(group).alias("__group"))
    kind, of_group = (vectors.schema[c].dataType.simpleString() for c in (id_, group))
    return in_rounds(rows.orderBy(id_), source, dims, scorer, columns.format(id=kind, group=of_group))


def _slices(ids: np.ndarray, q: np.ndarray, x: np.ndarray):
    """Scores of a block's rows against ``SLICE`` queries at a time, which bounds a task's memory."""
    for i in range(0, len(ids), SLICE):
        yield ids[i : i + SLICE], x @ q[i : i + SLICE].T


def _among_best(block: np.ndarray, limit: int | None) -> np.ndarray:
    """Which rows are among the ``limit`` best of each column; ties stay in."""
    if not limit or limit >= len(block):
        return np.ones_like(block, bool)
    return block >= np.partition(block, len(block) - limit, axis=0)[len(block) - limit] - 1e-6


def _tiles(batches):
    """Parts of ``TILE`` rows, where all scores are handed on."""
    for b in batches:
        for i in range(0, b.num_rows, TILE):
            yield b.slice(i, TILE)


def _best(held, limit: int | None, each_group: bool):
    def run(batches):
        for b in _tiles(batches) if limit is None else batches:
            if not b.num_rows:
                continue
            at_group = b.column(2).dictionary_encode(null_encoding="encode").indices.to_numpy() if each_group else np.zeros(b.num_rows, int)
            order = np.argsort(at_group, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(at_group[order])) + 1)
            for ids, block in _slices(*held.value, unit(_matrix(b.column(1)))):
                keep = np.zeros_like(block, bool)
                for own in parts:
                    keep[own] = _among_best(block[own], limit)
                at, col = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(ids[col]), b.column(0).take(pa.array(at)), b.column(2).take(pa.array(at)), pa.array(np.round(block[at, col], 6))], ["query", "id", "group", "cosine"])

    return run


def similarities(queries: DataFrame, vectors: DataFrame, id_: str, vector: str, group: str | None = None, limit: int | None = None, each_group: bool = False) -> DataFrame:
    """(query, id, group, cosine), for each query at least its ``limit`` best rows of
    every block (of each group in it, with ``each_group``), or all rows. ``queries(id, vector)`` go in rounds of a
    bounded size; queries of another size than the longest have no rows."""
    return _against(queries, vectors, id_, vector, group or id_, lambda held: _best(held, limit, each_group), "query {id}, id {id}, group {group}, cosine double")


def top_k(queries: DataFrame, vectors: DataFrame, id_: str, vector: str, limit: int, exclude_self: bool = True) -> DataFrame:
    """(query, id, cosine, rank): the best rows of each query."""
    found = similarities(queries, vectors, id_, vector, limit=limit + exclude_self)
    if exclude_self:
        found = found.where("query <> id")
    w = Window.partitionBy("query").orderBy(F.col("cosine").desc(), "id")
    return found.select("query", "id", "cosine", F.row_number().over(w).alias("rank")).where(F.col("rank") <= limit)


def _pooled(held):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            groups = b.column(2).dictionary_encode(null_encoding="encode")
            at = groups.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.diff(at[order], prepend=-1))
            n = len(groups.dictionary)
            for ids, block in _slices(*held.value, unit(_matrix(b.column(1)))[order]):
                best = np.maximum(np.maximum.reduceat(block, starts, axis=0), 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(ids, n)), groups.dictionary.take(pa.array(np.repeat(np.arange(n), len(ids)))), pa.array(np.round(best.reshape(-1), 6))], ["query", "group", "cosine"]
                )

    return run


def max_pooled(queries: DataFrame, vectors: DataFrame, id_: str, vector: str, group: str) -> DataFrame:
    """(query, group, cosine): the best cosine of each group, floored at 0;
    blocks hand on one row per query and group. Queries go in rounds of a bounded size."""
    found = _against(queries, vectors, id_, vector, group, _pooled, "query {id}, group {group}, cosine double")
    return found.groupBy("query", "group").agg(F.max("cosine").alias("cosine"))


def prune_by_floor(scored: DataFrame, group: list[str], score: str, ratio: float = 0.6, low: float = 0.05) -> DataFrame:
    """``scored`` with low, high and bar of its group and ``keep``: no score, or a
    score at the bar ``low + ratio * (high - low)``; a flat range keeps all."""
    stats = scored.groupBy(*group).agg(F.coalesce(F.percentile(score, F.lit(low)), F.lit(0.0)).alias("low"), F.coalesce(F.max(score), F.lit(0.0)).alias("high"))
    stats = stats.withColumn("bar", F.round(F.when((F.lit(ratio) <= 0) | (F.col("high") - F.col("low") < 1e-6), F.col("low")).otherwise(F.col("low") + ratio * (F.col("high") - F.col("low"))), 6))
    open_ = (F.lit(ratio) <= 0) | (F.col("high") - F.col("low") < 1e-6)
    return scored.join(stats, group).withColumn("keep", open_ | F.col(score).isNull() | (F.col(score) >= F.col("bar")))


def floor_sweep(scored: DataFrame, group: list[str], score: str, tokens: str, gold: str, ratios: list[float]) -> DataFrame:
    """Per ratio: token cut in percent, least recall of gold rows, failing groups."""
    low, high = F.percentile(score, F.lit(0.05)).alias("low"), F.max(score).alias("high")
    swept = scored.join(scored.groupBy(*group).agg(low, high), group).withColumn("ratio", F.explode(F.array(*map(F.lit, ratios))))
    open_ = (F.col("ratio") <= 0) | (F.col("high") - F.col("low") < 1e-6)
    keep = open_ | F.col(score).isNull() | (F.col(score) >= F.col("low") + F.col("ratio") * (F.col("high") - F.col("low")))
    per = swept.groupBy("ratio", *group).agg(
        F.sum(tokens).alias("all"), F.sum(F.when(~keep, F.col(tokens)).otherwise(0)).alias("cut"), F.sum(F.col(gold).cast("int")).alias("gold"), F.sum((F.col(gold) & keep).cast("int")).alias("kept")
    )
    recall = F.when(F.col("gold") == 0, 1.0).otherwise(F.col("kept") / F.col("gold"))
    return per.groupBy("ratio").agg(
        F.round(100 * F.sum("cut") / F.greatest(F.sum("all"), F.lit(1)), 6).alias("cut_percent"), F.round(F.min(recall), 6).alias("least_recall"), F.count_if(recall < 1).alias("failing")
    )


def stale_vectors(chunks: DataFrame, index: DataFrame, model: str, dimensions: int) -> DataFrame:
    """Chunks of ``chunks(article_id, ordinal, hash)`` without a usable vector of
    that hash, model and size in ``index``: the only ones to embed anew."""
    have = index.where((F.col("model") == model) & (F.col("dimensions") == dimensions) & usable(F.col("vector"), dimensions)).select("article_id", "hash")
    return chunks.join(have.distinct(), ["article_id", "hash"], "left_anti")


