"""The first rows of each query after demotion, without a rank for every score.

Demotion moves the flagged rows of a query's whole list back by a share of its length. The first ``limit``
rows are then among the ``limit`` best flagged and the ``limit`` best other rows; what is needed besides
are these rows' places in the whole list.

1. Every task keeps the best rows of either kind in all that it reads, and there are no more tasks than cores:
   the shuffle has at most ``2 * limit`` rows a query and core, however many rows the table has.
2. Where fewer than ``limit`` rows of the other kind come before a row, its place is known. A flagged row with more of them
   comes after ``limit`` other rows anyway. A row that is not flagged is placed as if all flagged rows of the
   table came before it, if even so it stays before the flagged rows, which have been moved back.
3. For the queries left, another pass over the flagged rows counts those before each row: one number a row and task.

Equal cosines go by id, in the tasks too, so copies of one vector do not add up."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators import ranking
from lorekeep.operators.vectors import _matrix, _slices, _tiles, asked, in_rounds, unit, usable
from lorekeep.storage import dealt, materialise, ship, spread

#: Queries of a round, whose best rows a task holds, and further rows that it holds before it sorts.
QUERIES, PENDING = 8192, 1 << 20
_ORDER = [("cell", "ascending"), ("cosine", "descending"), ("id", "ascending")]


def _sorted_best(parts: list[pa.Table], limit: int, bars: np.ndarray) -> pa.Table:
    """The first ``limit`` rows of each cell; full cells set their bar."""
    t = pa.concat_tables(parts)
    t = t.take(pc.sort_indices(t, sort_keys=_ORDER)).combine_chunks()
    cell = t["cell"].to_numpy()
    starts = np.flatnonzero(np.diff(cell, prepend=-1))
    place = np.arange(len(cell)) - np.repeat(starts, np.diff(starts, append=len(cell)))
    last = place == limit - 1
    bars[cell[last]] = t["cosine"].to_numpy()[last]
    return t.filter(pa.array(place < limit))


def _kept(held, limit: int):
    """Each query's ``limit`` best rows of either kind among all rows of a task. A cell is a query and a kind."""

    def run(batches):
        ids, q = held.value
        bars, found, pending, kind = np.full(2 * len(ids), -np.inf), [], 0, None
        for b in _tiles(batches):
            if not b.num_rows:
                continue
            # By id, so that a stable sort leaves equal cosines in its order.
            b = b.take(pc.sort_indices(b.column(0)))
            x, flag, kind = unit(_matrix(b.column(1))), np.asarray(b.column(2).to_numpy(zero_copy_only=False), bool), b.column(0).type
            row, cell, cosine = [], [], []
            for k in (0, 1):
                own, first = np.flatnonzero(flag == k), 0
                for part, block in _slices(ids, q, x[own]) if len(own) else ():
                    bar = bars[2 * first + k : 2 * (first + len(part)) : 2]
                    at, col = np.nonzero(block >= bar - 1e-6)
                    if len(at) > 2 * limit * len(part):
                        best = np.argsort(-np.round(block, 6), axis=0, kind="stable")[:limit]
                        at, col = best.ravel(), np.tile(np.arange(len(part)), len(best))
                    row.append(own[at])
                    cell.append(2 * (first + col) + k)
                    cosine.append(np.round(block[at, col], 6) + 0.0)
                    first += len(part)
            row, cell, cosine = map(np.concatenate, (row, cell, cosine))
            if len(row):
                found.append(pa.table([pa.array(cell), pa.array(cosine), b.column(0).take(pa.array(row))], ["cell", "cosine", "id"]))
                pending += len(row)
            if pending > PENDING or len(found) > 1024:
                found, pending = [_sorted_best(found, limit, bars)], 0
        if found:
            for b in _sorted_best(found, limit, bars).to_batches(max_chunksize=1 << 16):
                cell = b.column("cell").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[cell // 2]).cast(kind), b.column("id"), pa.array(cell % 2 == 1), b.column("cosine")], ["query", "id", "flagged", "cosine"])

    return run


def _before(held, limit: int):
    """How many rows of a task come before each of a query's marks (cosine and id)."""

    def run(batches):
        (ids, q, cosines, own_ids), kind = held.value, None
        bar, n = np.full((len(ids), limit), np.inf), np.zeros((len(ids), limit), np.int64)
        for i, c in enumerate(cosines):
            bar[i, : len(c)] = c
        marks = pa.array([m[j] if j < len(m) else None for m in own_ids for j in range(limit)])
        for b in _tiles(batches):
            if not b.num_rows:
                continue
            kind, first = b.column(0).type, 0
            for part, block in _slices(ids, q, unit(_matrix(b.column(1)))):
                block, own = np.round(block, 6), slice(first, first + len(part))
                for j in range(limit):
                    above, reached = (np.count_nonzero(x, axis=0) for x in (block > bar[own, j], block >= bar[own, j]))
                    n[own, j] += above
                    if (above != reached).any():
                        at, col = np.nonzero(block == bar[own, j])
                        a, m = b.column(0).take(pa.array(at)), marks.take(pa.array((first + col) * limit + j)).cast(kind)
                        # An id that is null comes last.
                        less = pc.fill_null(pc.less(a, m), pc.and_(pc.is_valid(a), pc.is_null(m))).to_numpy(zero_copy_only=False)
                        n[own, j] += np.bincount(col[np.asarray(less, bool)], minlength=len(part))
                first += len(part)
        if kind is not None:
            at, j = np.nonzero(np.isfinite(bar))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]).cast(kind), pa.array((j + 1).astype(np.int32)), pa.array(n[at, j])], ["query", "place", "n"])

    return run


def top_demoted(queries: DataFrame, rows: DataFrame, id_: str, vector: str, flagged: Column, limit: int, factor: float = 0.15) -> DataFrame:
    """(query, id, rank): what ``ranking.demote`` leaves of all ``rows(id, vector)`` by cosine, then id, for each of
    ``queries(id, vector)``. ``flagged`` is a condition on the rows."""
    spark, kept, factor = rows.sparkSession, max(1, limit), max(0.0, min(1.0, factor))
    ship(spark)
    known, dims = asked(queries, id_, vector)
    source = spread(rows.where(usable(F.col(vector), dims)).select(F.col(id_).alias("__id"), F.col(vector).alias("__vector"), F.coalesce(flagged, F.lit(False)).alias("__flagged")))
    total, n_flagged = source.agg(F.count(F.lit(1)), F.count_if("__flagged")).first()
    tasks = spark.sparkContext.defaultParallelism
    source = source.coalesce(tasks) if source.rdd.getNumPartitions() > tasks else source
    kind = rows.schema[id_].dataType.simpleString()
    # A query's id may stand for several vectors, whose rows are one list.
    copies = known.groupBy(F.col(id_).alias("query")).agg(F.count(F.lit(1)).alias("copies"))
    size, all_flagged = F.col("copies") * total, F.col("copies") * n_flagged

    best = in_rounds(known.orderBy(id_), source, dims, lambda held: _kept(held, kept), f"query {kind}, id {kind}, flagged boolean, cosine double", QUERIES)
    order, unsure = (F.col("cosine").desc(), F.col("id").asc_nulls_last()), ~F.col("flagged") & (F.col("among") - F.col("place") >= kept)
    best = dealt(best, 2 * kept * tasks * known.count(), "query").withColumn("place", F.row_number().over(Window.partitionBy("query", "flagged").orderBy(*order))).where(F.col("place") <= kept)
    best = materialise(best.withColumn("among", F.row_number().over(Window.partitionBy("query").orderBy(*order))), "best-of-either-kind")
    ends = best.groupBy("query").agg(F.max(F.when(unsure, F.col("place"))).alias("last"), F.min(F.when(F.col("flagged"), F.col("among"))).alias("first")).join(copies, "query")
    left = materialise(ends.where(F.col("last") + all_flagged >= F.col("first") + ranking.penalty(size, limit, factor)).select("query"), "places-to-count")
    place = F.col("place") + all_flagged
    if factor > 0 and not left.isEmpty():
        marks = best.where(~F.col("flagged")).join(left, "query", "left_semi").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "cosine", "id"))).alias("m"))
        again = known.join(marks, F.col(id_) == F.col("query")).select(id_, vector, "m.cosine", "m.id").orderBy(id_)
        counted = in_rounds(again, source.where("__flagged"), dims, lambda held: _before(held, kept), f"query {kind}, place int, n bigint", QUERIES)
        best = best.join(counted.groupBy("query", "place").agg(F.sum("n").alias("before")), ["query", "place"], "left")
        place = F.coalesce(F.col("place") + F.col("before"), place)
    ranked = best.join(copies, "query").select("query", "id", "flagged", F.when(unsure, place).otherwise(F.col("among")).alias("rank"), size.alias("size"))
    return ranking.demote(ranked, ["query"], F.col("flagged"), limit, factor, size=F.col("size")).select("query", "id", "rank")
