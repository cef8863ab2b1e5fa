"""A stored inverted index with block maxima, and top-k search over it.

Units (documents, pages, chunks) are numbered and written once, with what a result
needs of them. Their postings are grouped by (term, shard), a shard being ``SHARD``
consecutive numbers, so no list is longer, however frequent its term. A row holds the postings in
blocks of ``BLOCK`` consecutive numbers, each with the greatest value in it; a
shard's rows are made in one task and lie by term.

A value is what a term adds to a unit's score before the query's weight. A search adds
the weighted maxima of each block: that bounds every score in it. Blocks are
read from the highest bound down until no bound reaches the query's kth best score, which is
carried from shard to shard; the postings of the other blocks are never scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.storage import materialise, ship

SHARD, BLOCK = 8192, 128
#: Words that a task which makes postings codes at once.
SLICE_WORDS = 200_000
#: Distinct terms, and queries, that one round of a search broadcasts.
MOST_TERMS, MOST_QUERIES = 1_000_000, 20_000
#: Scores are compared after rounding to six places, so nearer ones may tie.
SLACK = 2e-6
#: The term under which a shard lists a value of each unit itself; no token is empty.
UNIT = ""
_BLOCKS = "array<struct<block:int,top:double,postings:array<struct<local:int,value:double>>>>"


@dataclass
class LexicalIndex:
    units: DataFrame
    postings: DataFrame

    @staticmethod
    def open(spark: SparkSession, path: str) -> LexicalIndex:
        return LexicalIndex(spark.read.parquet(f"{path}/units"), spark.read.parquet(f"{path}/postings"))


def number_units(units: DataFrame, path: str) -> DataFrame:
    """Writes the units with a number each, and reads them back."""
    units.select(F.monotonically_increasing_id().alias("unit"), "*").write.option("compression", "zstd").parquet(f"{path}/units")
    return units.sparkSession.read.parquet(f"{path}/units")


class _Postings:
    """Postings of one shard, taken up in slices of units in order."""

    def __init__(self, shard: int):
        self.shard, self.n = shard, 0
        self.terms, self.codes, self.locals, self.values = [], [], [], []

    def add(self, terms: pa.Array, codes: np.ndarray, local: np.ndarray, value: np.ndarray) -> None:
        self.terms.append(terms)
        self.codes.append(codes + self.n)
        self.locals.append(local.astype(np.int32))
        self.values.append(value)
        self.n += len(terms)

    def rows(self) -> Iterator[pa.RecordBatch]:
        coded = pa.concat_arrays(self.terms).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        row = place[coded.indices.to_numpy()][np.concatenate(self.codes)]
        by_row = np.argsort(row, kind="stable")
        row, local, value = row[by_row], np.concatenate(self.locals)[by_row], np.concatenate(self.values)[by_row]
        cell = row * (SHARD // BLOCK) + local // BLOCK
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        postings = pa.ListArray.from_arrays(pa.array(np.append(first, len(cell)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(local), pa.array(value)], ["local", "value"]))
        tops = np.maximum.reduceat(value, first) if len(first) else value
        blocks = pa.StructArray.from_arrays([pa.array((local[first] // BLOCK).astype(np.int32)), pa.array(tops), postings], ["block", "top", "postings"])
        at = np.searchsorted(row[first], np.arange(len(order) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(order), pa.array(np.full(len(order), self.shard)), pa.ListArray.from_arrays(pa.array(at), blocks)], ["term", "shard", "blocks"])


def _slices_of_shards(batches) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(shard, rows) of batches in order of their units, of some ``SLICE_WORDS`` words each."""
    for b in batches:
        shard = b.column(0).to_numpy() // SHARD
        words = np.cumsum(sum(pc.list_value_length(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns[2:]))
        cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(words // SLICE_WORDS) != 0)) + 1
        for i, j in zip([0, *cuts], [*cuts, b.num_rows]):
            if i < j:
                yield int(shard[i]), b.slice(i, j - i)


def _posted(value, own: bool):
    def run(batches):
        held = None
        for shard, b in _slices_of_shards(batches):
            if held is not None and held.shard != shard:
                yield from held.rows()
                held = None
            held = held or _Postings(shard)
            unit, number, lists = b.column(0).to_numpy(), b.column(1).to_numpy(), b.columns[2:]
            coded = pa.concat_arrays([c.flatten() for c in lists]).dictionary_encode()
            sizes = [pc.list_value_length(c).fill_null(0).to_numpy(zero_copy_only=False) for c in lists]
            row = np.concatenate([np.repeat(np.arange(len(n)), n) for n in sizes])
            keys, at = np.unique(row * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)
            ends = np.cumsum([n.sum() for n in sizes])
            counts = [np.bincount(at[e - n.sum() : e], minlength=len(keys)) for e, n in zip(ends, sizes)]
            row, code = np.divmod(keys, max(1, len(coded.dictionary)))
            held.add(coded.dictionary, code, unit[row] % SHARD, value(counts, number[row]))
            less = np.flatnonzero(number != 1)
            if own and len(less):
                held.add(pa.array([UNIT]), np.zeros(len(less), np.int64), unit[less] % SHARD, number[less])
        if held is not None:
            yield from held.rows()

    return run


def postings(units: DataFrame, number: str, lists: list[Column], value: Callable[[list[np.ndarray], np.ndarray], np.ndarray], own: bool = False, keep: Column | None = None) -> DataFrame:
    """(term, shard, blocks) of ``units(unit, number)`` by the terms in their ``lists``. ``value(counts, number)`` is what
    a term adds to a unit, by how often each list holds it; ``own`` lists the numbers other than 1 under ``UNIT``, and
    ``keep`` is a condition on ``term``. Units are dealt once, by shard, so a shard's lists are made where it lies."""
    ship(units.sparkSession)
    narrow = units.withColumn("__shard", F.floor(F.col("unit") / SHARD)).repartition("__shard").sortWithinPartitions("unit")
    named = [c.alias(f"list{i}") for i, c in enumerate(lists)]
    made = narrow.select("unit", F.col(number).cast("double").alias("number"), *named).mapInArrow(_posted(value, own), f"term string, shard bigint, blocks {_BLOCKS}")
    return made if keep is None else made.where(keep | (F.col("term") == UNIT))


def write_postings(made: DataFrame, path: str) -> DataFrame:
    """Writes ``postings``."""
    made.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(f"{path}/postings")
    return made.sparkSession.read.parquet(f"{path}/postings")


class _Queries:
    """Queries of a round: codes of their distinct terms."""

    def __init__(self, keys: pa.Array, lists: pa.ListArray):
        self.keys = keys
        coded = lists.flatten().dictionary_encode()
        self.terms = coded.dictionary
        sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        code = coded.indices.to_numpy(zero_copy_only=False)
        self.codes = [code[e - n : e] for e, n in zip(ends, sizes)]
        self.weights: np.ndarray | None = None


def _runs(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges lo..hi-1."""
    n = hi - lo
    return np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)


class _Shard:
    def __init__(self, table: pa.Table, queries: _Queries):
        table = table.combine_chunks()
        terms, lists = (table.column(c).chunk(0) for c in ("term", "blocks"))
        blocks = lists.flatten()
        postings = blocks.field("postings")
        self.block, self.top = blocks.field("block").to_numpy(), blocks.field("top").to_numpy()
        self.at, self.posting_at = (x.offsets.to_numpy().astype(np.int64) - x.offsets[0].as_py() for x in (lists, postings))
        entries = postings.flatten()
        self.local, self.value = entries.field("local").to_numpy(), entries.field("value").to_numpy()
        code = pc.index_in(terms, value_set=queries.terms).fill_null(-1).to_numpy(zero_copy_only=False)
        self.row = np.full(len(queries.terms) + 1, -1)
        self.row[code] = np.arange(len(code))
        own = np.flatnonzero(np.asarray(terms.to_numpy(zero_copy_only=False) == UNIT))
        self.unit = np.ones(SHARD)
        if len(own):
            mine = self._postings(_runs(self.at[own], self.at[own + 1]))[0]
            self.unit[self.local[mine]] = self.value[mine]

    def _postings(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.posting_at[blocks], self.posting_at[blocks + 1]
        return _runs(lo, hi), hi - lo

    def search(self, codes: np.ndarray, weights: np.ndarray | None, limit: int, phrase: float, best: np.ndarray):
        """(locals, sums, hits, lower bounds, postings scored) of the units that may be among the
        best, whose lower bounds so far are ``best`` (ascending)."""
        scale = np.full(len(codes), 1 / max(1, len(codes))) if weights is None else weights[codes]
        rows, w = self.row[codes], scale
        rows, w = rows[rows >= 0], w[rows >= 0]
        sizes = self.at[rows + 1] - self.at[rows]
        mine, w = _runs(self.at[rows], self.at[rows + 1]), np.repeat(w, sizes)
        bound = np.bincount(self.block[mine], w * self.top[mine], SHARD // BLOCK)
        held = np.bincount(self.block[mine], minlength=SHARD // BLOCK)
        bound = np.where(held > 0, bound + phrase * (held > 1), -np.inf)
        order = np.argsort(-bound, kind="stable")[: np.count_nonzero(held)]
        found, read, at, step = [], 0, 0, 2
        while at < len(order) and bound[order[at]] >= best[0] - SLACK:
            chosen = np.zeros(SHARD // BLOCK, bool)
            chosen[order[at : at + step]] = True
            use = chosen[self.block[mine]]
            place, n = self._postings(mine[use])
            local = self.local[place]
            total = np.bincount(local, np.repeat(w[use], n) * self.value[place], SHARD)
            hits = np.bincount(local, minlength=SHARD)
            some = np.flatnonzero(hits)
            total, hits = total[some], hits[some]
            low = total + phrase * self.unit[some] * (hits > 1) * np.minimum(0.75, hits / max(1, len(codes)))
            best = np.sort(np.concatenate([best, low]))[-limit:]
            found.append((some, total, hits, low))
            read, at, step = read + len(place), at + step, 2 * step
        return [np.concatenate(x) for x in zip(*found)] if found else None, best, read


def _by_shard(batches) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        shards = b.column(1).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shards)) + 1, [len(shards)]])
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if i < j:
                if held and held[0].column(1)[0].as_py() != shards[i]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _search(shared, limit: int, phrase: float, names: list[str]):
    def run(batches):
        q: _Queries = shared.value
        best = np.full((len(q.codes), limit), -np.inf)
        for table in _by_shard(batches):
            shard, out, scored = _Shard(table, q), [], 0
            for i, codes in enumerate(q.codes):
                if len(codes):
                    found, best[i], read = shard.search(codes, q.weights, limit, phrase, best[i])
                    scored += read
                    if found:
                        local, total, hits, low = found
                        high = low if not phrase else total + phrase * shard.unit[local] * (hits > 1)
                        keep = high >= best[i][0] - SLACK
                        out.append((np.full(keep.sum(), i), local[keep], total[keep], hits[keep], low[keep], high[keep]))
            if out:
                query, local, total, hits, low, high = (np.concatenate(x) for x in zip(*out))
                first = table.column(1)[0].as_py() * SHARD
                numbers = [pa.array(local + first, pa.int64()), pa.array(total), pa.array(hits, pa.int64()), pa.array(low), pa.array(high), pa.array(np.full(len(query), scored), pa.int64())]
                yield pa.RecordBatch.from_arrays([q.keys.take(pa.array(query)), *numbers], names)

    return run


def candidates(index: LexicalIndex, queries: DataFrame, query_key: str, terms: Column, limit: int, phrase: float = 0.0, weigh: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(query, unit, total, hits, low, high, scored): the units that may be among a query's ``limit``
    best, with the weighted sum of their values, how many of the terms they hold, the bounds of
    their scores and the number of postings that were scored in their shard.

    ``weigh`` gives the terms' weights by the number of units that hold them; without it a
    query's weights are equal and add up to one. ``phrase`` is the most that the order of terms can add."""
    spark = index.units.sparkSession
    ship(spark)
    listed = queries.select(F.col(query_key), F.array_distinct(terms).alias("terms"))
    count, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    rounds = max(1, -(-count // MOST_QUERIES), -(-size // MOST_TERMS))
    names = [query_key, "unit", "total", "hits", "low", "high", "scored"]
    schema = f"`{query_key}` {queries.schema[query_key].dataType.simpleString()}, unit bigint, total double, hits bigint, low double, high double, scored bigint"
    found = []
    for r in range(rounds):
        own = listed if rounds == 1 else listed.where(F.pmod(F.xxhash64(query_key, "terms"), F.lit(rounds)) == r)
        table = own.toArrow().combine_chunks()
        q = _Queries(*(table.column(i).chunk(0) if table.num_rows else pa.array([], table.schema.field(i).type) for i in (0, 1)))
        asked = own.select(F.explode("terms").alias("term")).distinct()
        if phrase:
            asked = asked.unionByName(spark.range(1).select(F.lit(UNIT).alias("term")))
        rows = index.postings.join(asked, "term", "left_semi")
        if weigh:
            often = np.zeros(len(q.terms))
            sizes = F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.size(b["postings"]))
            place = {t: i for i, t in enumerate(q.terms.to_pylist())}
            for term, n in rows.groupBy("term").agg(F.sum(sizes)).collect():  # at most one row a term of the round
                often[place[term]] = n
            q.weights = weigh(often)
        dealt = rows.repartition("shard").sortWithinPartitions("shard")
        out = dealt.mapInArrow(_search(spark.sparkContext.broadcast(q), limit, phrase, names), schema)
        found.append(out if rounds == 1 else materialise(out, "search-round"))
    return reduce(DataFrame.unionByName, found)
