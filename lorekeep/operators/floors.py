"""Floors of similarity without the scores of all pairs.

A floor needs a low percentile and the maximum of a query's cosines over all rows, and then
counts of the rows above it. Three passes over the rows, none of which shuffles pairs:

1. Every task counts its cosines in ``BINS`` equal bins and keeps the maximum: one mergeable
   summary a query and task. The sums say in which bins the percentile's two neighbours lie.
2. Of these bins alone the distinct cosines are counted, which gives the percentile exactly.
3. Every task counts its rows above the queries' bars.

Queries go in rounds of ``QUERIES``; a round's vectors are broadcast and a task holds its
counts. Cosines are rounded to six places, as in the searches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.vectors import unit, usable
from lorekeep.storage import materialise, ship

BINS, QUERIES, SLICE = 4096, 1024, 64


def _bin(cosines: np.ndarray) -> np.ndarray:
    return np.clip(((cosines + 1) * (BINS / 2)).astype(np.int64), 0, BINS - 1)


def _flat(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


class _Round:
    """Numbers, unit vectors and wanted groups of a round's queries."""

    def __init__(self, table: pa.Table):
        self.keys, self.x = table.column("query").combine_chunks(), unit(_flat(table.column("vector").combine_chunks()))
        self.want = table.column("want").to_numpy(zero_copy_only=False)


def _cosines(q: _Round, batches) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """(first query, cosines of some queries (rows) with a batch (columns), batch)."""
    for b in batches:
        if b.num_rows:
            x = unit(_flat(b.column("vector")))
            for i in range(0, len(q.x), SLICE):
                yield i, np.round(q.x[i : i + SLICE] @ x.T, 6), b


def _summaries(shared):
    def run(batches):
        q: _Round = shared.value
        counts, top = np.zeros((len(q.x), BINS), np.int64), np.full(len(q.x), -np.inf)
        for i, c, _ in _cosines(q, batches):
            own = np.arange(len(c))[:, None] * BINS
            counts[i : i + len(c)] += np.bincount((own + _bin(c)).ravel(), minlength=len(c) * BINS).reshape(-1, BINS)
            np.maximum(top[i : i + len(c)], c.max(1), out=top[i : i + len(c)])
        row, bin_ = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([q.keys.take(pa.array(row)), pa.array(bin_), pa.array(counts[row, bin_]), pa.array(top[row])], ["query", "bin", "n", "top"])

    return run


def _within(shared):
    """Counts of the distinct cosines in the bins of a range a query."""

    def run(batches):
        (q, low, high), found = shared.value, []
        for i, c, _ in _cosines(q, batches):
            at = _bin(c)
            row, column = np.nonzero((at >= low[i : i + len(c), None]) & (at <= high[i : i + len(c), None]))
            cell, n = np.unique(np.stack([row + i, np.round(c[row, column] * 1e6).astype(np.int64)]), axis=1, return_counts=True)
            found.append(np.vstack([cell, n]))
            if sum(f.shape[1] for f in found) > 1 << 18:
                found = [_merged(found)]
        row, micro, n = _merged(found) if found else np.zeros((3, 0), np.int64)
        yield pa.RecordBatch.from_arrays([q.keys.take(pa.array(row)), pa.array(micro / 1e6), pa.array(n)], ["query", "cosine", "n"])

    return run


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    whole = np.concatenate(parts, axis=1)
    cell, where = np.unique(whole[:2], axis=1, return_inverse=True)
    return np.vstack([cell, np.bincount(where.ravel(), whole[2], cell.shape[1]).astype(np.int64)])


def _sums(shared, measures: int):
    """Sums of each bar's measures: rows, rows kept, tokens, tokens cut, wanted rows, wanted rows kept."""

    def run(batches):
        (q, bars), total = shared.value, None
        for i, c, b in _cosines(q, batches):
            if total is None:
                total = np.zeros((len(q.x), bars.shape[1], 6), np.int64)
            tokens, group = b.column("tokens").to_numpy(), b.column("grp").to_numpy(zero_copy_only=False)
            gold = np.asarray(q.want[i : i + len(c), None] == group, bool)
            for k in range(bars.shape[1]):
                keep = c >= bars[i : i + len(c), k, None]
                for m, part in enumerate((np.ones_like(keep), keep)):
                    total[i : i + len(c), k, m] += part.sum(1)
                total[i : i + len(c), k, 2] += tokens.sum()
                total[i : i + len(c), k, 3] += np.where(keep, 0, tokens).sum(1)
                total[i : i + len(c), k, 4] += gold.sum(1)
                total[i : i + len(c), k, 5] += (gold & keep).sum(1)
        if total is not None:
            row, k = (x.ravel() for x in np.indices(total.shape[:2]))
            yield pa.RecordBatch.from_arrays([q.keys.take(pa.array(row)), pa.array(k), *(pa.array(total[row, k, m]) for m in range(measures))], ["query", "bar", "n", "kept", "tokens", "cut", "gold", "gold_kept"])

    return run


def floor_counts(
    queries: DataFrame,
    rows: DataFrame,
    id_: str,
    vector: str,
    bars: Callable[[np.ndarray, np.ndarray], np.ndarray],
    share: float = 0.05,
    tokens: str | None = None,
    want: str | None = None,
    group: str | None = None,
) -> DataFrame:
    """(query, low, high, bar, n, kept, tokens, cut, gold, gold_kept): counts over all usable
    ``rows`` at each bar that ``bars(low, high)`` sets (a column a bar, -inf keeps all), where low
    is the interpolated percentile ``share`` of a query's cosines and high their maximum.

    ``tokens`` is a column of the rows; wanted rows are those whose ``group`` equals the query's
    ``want``. ``bar`` numbers the bars. Vectors of another size than the longest take no part."""
    spark = rows.sparkSession
    ship(spark)
    asked = queries.where(usable(F.col(vector))).select(F.col(id_).alias("query"), F.col(vector).alias("vector"), F.col(want or id_).alias("want"))
    dims = asked.agg(F.max(F.size("vector"))).first()[0] or 1
    asked = asked.where(F.size("vector") == dims)
    source = rows.where(usable(F.col(vector), dims)).select(F.col(vector).alias("vector"), (F.col(tokens) if tokens else F.lit(1)).cast("long").alias("tokens"), F.col(group or id_).alias("grp"))
    kind = asked.schema["query"].dataType.simpleString()
    schema = f"query {kind}, low double, high double, bar bigint, n bigint, kept bigint, tokens bigint, cut bigint, gold bigint, gold_kept bigint"
    rounds = max(1, -(-asked.count() // QUERIES))
    out = []
    for r in range(rounds):
        own = asked if rounds == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(rounds)) == r)
        table = own.toArrow().combine_chunks()
        if not table.num_rows:
            continue
        q = _Round(table)
        place = {k: i for i, k in enumerate(q.keys.to_pylist())}
        counted = source.mapInArrow(_summaries(spark.sparkContext.broadcast(q)), f"query {kind}, bin bigint, n bigint, top double")
        summary = materialise(counted.groupBy("query", "bin").agg(F.sum("n").alias("n"), F.max("top").alias("top")), "floor-summaries")
        by_bin, every = Window.partitionBy("query").orderBy("bin"), Window.partitionBy("query")
        ranked = summary.withColumns({"upto": F.sum("n").over(by_bin), "total": F.sum("n").over(every), "high": F.max("top").over(every)})
        # Zero-based places of the percentile's two neighbours.
        at = (F.col("total") - 1) * share
        holds = lambda p: (F.col("upto") > p) & (F.col("upto") - F.col("n") <= p)
        bounds = ranked.groupBy("query").agg(
            F.min(F.when(holds(F.floor(at)), F.col("bin"))).alias("first"), F.max(F.when(holds(F.ceil(at)), F.col("bin"))).alias("last"), F.min(F.when(holds(F.floor(at)), F.col("upto") - F.col("n"))).alias("before"), F.first("total").alias("total"), F.max("high").alias("high")
        )
        first, last, before, total, high = (np.zeros(len(place), t) for t in (np.int64, np.int64, np.int64, np.int64, float))
        for row in bounds.collect():  # one row a query of the round
            i = place[row["query"]]
            first[i], last[i], before[i], total[i], high[i] = row["first"], row["last"], row["before"], row["total"], row["high"]
        refined = source.mapInArrow(_within(spark.sparkContext.broadcast((q, first, last))), f"query {kind}, cosine double, n bigint")
        values = refined.groupBy("query", "cosine").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(Window.partitionBy("query").orderBy("cosine")))
        known = spark.createDataFrame([(k, int(before[i]), int(total[i])) for k, i in place.items()], f"query {kind}, before bigint, total bigint")
        near = values.join(F.broadcast(known), "query").withColumn("upto", F.col("upto") + F.col("before"))
        at = (F.col("total") - 1) * share
        ends = near.groupBy("query").agg(F.min(F.when(holds(F.floor(at)), F.col("cosine"))).alias("x"), F.min(F.when(holds(F.ceil(at)), F.col("cosine"))).alias("y"), F.first(at - F.floor(at)).alias("part"))
        low = np.zeros(len(place))
        for row in ends.collect():  # one row a query of the round
            low[place[row["query"]]] = row.x * (1 - row.part) + row.y * row.part
        levels = bars(low, high)
        sums = source.mapInArrow(_sums(spark.sparkContext.broadcast((q, levels)), 6), f"query {kind}, bar bigint, n bigint, kept bigint, tokens bigint, cut bigint, gold bigint, gold_kept bigint")
        added = sums.groupBy("query", "bar").agg(*(F.sum(c).alias(c) for c in ("n", "kept", "tokens", "cut", "gold", "gold_kept")))
        floors = spark.createDataFrame([(k, float(low[i]), float(high[i])) for k, i in place.items()], f"query {kind}, low double, high double")
        out.append(materialise(floors.join(added, "query"), "floor-counts"))
    return reduce(DataFrame.unionByName, out).select(*[c.split()[0] for c in schema.split(", ")]) if out else spark.createDataFrame([], schema)


def open_bar(low: np.ndarray, high: np.ndarray, ratio: float, digits: int | None = None) -> np.ndarray:
    """The bar ``low + ratio * (high - low)``; none where the ratio or the range is nought."""
    bar = low + ratio * (high - low)
    return np.where((ratio <= 0) | (high - low < 1e-6), -np.inf, bar if digits is None else np.round(bar, digits))


def prune_counts(queries: DataFrame, rows: DataFrame, id_: str, vector: str, ratio: float = 0.6, share: float = 0.05) -> DataFrame:
    """(query, bar, kept, n): each query's floor and how many rows it keeps."""
    found = floor_counts(queries, rows, id_, vector, lambda low, high: open_bar(low, high, ratio, 6)[:, None], share)
    flat = (F.lit(ratio) <= 0) | (F.col("high") - F.col("low") < 1e-6)
    bar = F.round(F.when(flat, F.col("low")).otherwise(F.col("low") + ratio * (F.col("high") - F.col("low"))), 6)
    return found.select("query", bar.alias("bar"), "kept", "n")


def sweep_counts(queries: DataFrame, rows: DataFrame, id_: str, vector: str, tokens: str, want: str, group: str, ratios: list[float], share: float = 0.05) -> DataFrame:
    """Per ratio: token cut in percent, least recall of wanted rows, failing queries."""
    found = floor_counts(queries, rows, id_, vector, lambda low, high: np.stack([open_bar(low, high, r) for r in ratios], 1), share, tokens, want, group)
    recall = F.when(F.col("gold") == 0, 1.0).otherwise(F.col("gold_kept") / F.col("gold"))
    per = found.groupBy("bar").agg(F.round(100 * F.sum("cut") / F.greatest(F.sum("tokens"), F.lit(1)), 6).alias("cut_percent"), F.round(F.min(recall), 6).alias("least_recall"), F.count_if(recall < 1).alias("failing"))
    named = F.element_at(F.array(*map(F.lit, ratios)), (F.col("bar") + 1).cast("int"))
    return per.select(named.alias("ratio"), "cut_percent", "least_recall", "failing")
