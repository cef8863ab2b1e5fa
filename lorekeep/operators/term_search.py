"""Scoring a set of queries where documents are read.

The queries' terms are broadcast, at most ``MOST_TERMS`` of them (and ``MOST_QUERIES``
queries) at a time; larger sets are searched in rounds. Each task scores its
documents against the terms that they hold and hands on only those that can
still be among a query's best, so what is shuffled grows with queries, not with
pairs of queries and documents."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.storage import materialise, ship

MOST_TERMS, MOST_QUERIES = 1_000_000, 20_000
#: Pairs of a document and a query, and of a term held and a query that asks for it, that a task
#: scores at once, and words that it codes at once.
CELLS, WORDS = 1 << 20, 500_000
#: Scores are compared after rounding to six places, so nearer ones may tie.
SLACK = 2e-6


class Asked:
    """Queries by term: which of them ask for each distinct term."""

    def __init__(self, keys: pa.Array, terms: pa.ListArray):
        self.keys = keys
        self.sizes = pc.list_value_length(terms).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = terms.flatten().dictionary_encode()
        self.terms = coded.dictionary
        code, owner = coded.indices.to_numpy(), np.repeat(np.arange(len(keys)), self.sizes)
        order = np.argsort(code, kind="stable")
        self.queries = owner[order]
        self.count = np.bincount(code, minlength=len(self.terms))
        self.first = np.concatenate([[0], np.cumsum(self.count)[:-1]]).astype(np.int64)

    def hits(self, row: np.ndarray, code: np.ndarray, weight: np.ndarray | None, rows: int) -> np.ndarray:
        """Sums for each of ``rows`` documents and each query."""
        k = self.count[code]
        ends = np.cumsum(k)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - k - self.first[code], k)
        cell = np.repeat(row, k) * len(self.keys) + self.queries[place]
        return np.bincount(cell, None if weight is None else np.repeat(weight, k), rows * len(self.keys)).reshape(rows, -1)


def _slices(batches, carried: int, fields: int):
    """Parts of batches with some ``WORDS`` words each."""
    for b in batches:
        words = np.cumsum(sum(pc.list_value_length(b.column(f)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for f in range(carried, carried + fields)))
        cuts = (np.flatnonzero(np.diff(words // WORDS)) + 1).tolist()
        for i, j in zip([0, *cuts], [*cuts, b.num_rows]):
            if i < j:
                yield b.slice(i, j - i)


def _search(asked, carried: int, fields: int, union: bool, weigh, rate, limit: int, names: list[str]):
    def run(batches):
        a: Asked = asked.value
        width = len(a.keys)
        best = np.zeros((0, width))
        for b in _slices(batches, carried, fields):
            if not width:
                continue
            coded = []
            for f in range(carried, carried + fields):
                lists = b.column(f)
                code = pc.index_in(lists.flatten(), value_set=a.terms).fill_null(-1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
                coded.append((row[code >= 0], code[code >= 0].astype(np.int64)))
            if union:
                pairs = np.unique(np.concatenate([row * len(a.terms) + code for row, code in coded]))
                coded.append(np.divmod(pairs, max(len(a.terms), 1)))
            pairs = np.cumsum(sum(np.bincount(row, a.count[code], b.num_rows) for row, code in coded))
            step, end = max(1, CELLS // width), 0
            while end < b.num_rows:
                at, before = end, pairs[end - 1] if end else 0
                end = min(at + step, max(at + 1, int(np.searchsorted(pairs, before + CELLS, "right"))))
                part = b.slice(at, end - at)
                hits = []
                for row, code in coded:
                    i, j = np.searchsorted(row, [at, at + part.num_rows])
                    r, c, w = row[i:j] - at, code[i:j], None
                    if weigh:
                        pair, often = np.unique(r * len(a.terms) + c, return_counts=True)
                        r, c = np.divmod(pair, len(a.terms))
                        w = weigh(c, often, r, part)
                    hits.append(a.hits(r, c, w, part.num_rows))
                low, high = rate(hits, a.sizes, part)
                some = reduce(np.logical_or, [h > 0 for h in hits])
                best = np.concatenate([best, np.where(some, low, -np.inf)])
                if len(best) > limit:
                    best = np.partition(best, len(best) - limit, axis=0)[len(best) - limit :]
                bar = best.min(0) if len(best) == limit else np.full(width, -np.inf)
                r, q = np.nonzero(some & (high >= bar - SLACK))
                kept = [part.column(k).take(pa.array(r)) for k in range(carried)]
                yield pa.RecordBatch.from_arrays([a.keys.take(pa.array(q)), *kept, *(pa.array(h[r, q].astype(np.float64)) for h in hits)], names)

    return run


def candidates(
    queries: DataFrame,
    query_key: str,
    terms: Column,
    docs: DataFrame,
    carry: dict[str, Column],
    fields: dict[str, Column],
    limit: int,
    rate: Callable,
    weigh: Callable[[list], Callable] | None = None,
    union: str | None = None,
) -> DataFrame:
    """(query, *carry, *fields): pairs of a query and a document that share a term and
    may be among the query's ``limit`` best, with the sum of hits of each field.

    ``rate(hits, sizes, batch)`` bounds the scores of documents (rows) for queries from
    below and above. ``weigh(terms)`` gives the weight function of a term that occurs some
    times in a document; without it each element of a field (a set) counts one. ``union`` names
    one more field, the terms that any other holds."""
    spark = docs.sparkSession
    ship(spark)
    listed = queries.select(F.col(query_key), F.array_distinct(terms).alias("terms"))
    count, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    rounds = max(1, -(-count // MOST_QUERIES), -(-size // MOST_TERMS))
    read = docs.select(*[c.alias(n) for n, c in carry.items()], *[c.alias(f"list of {n}") for n, c in fields.items()])
    names = [*carry, *fields, *([union] if union else [])]
    kinds = [f"`{query_key}` {queries.schema[query_key].dataType.simpleString()}", *(f"`{n}` {read.schema[n].dataType.simpleString()}" for n in carry), *(f"`{n}` double" for n in names[len(carry) :])]
    found = []
    for r in range(rounds):
        own = listed if rounds == 1 else listed.where(F.pmod(F.xxhash64(query_key), F.lit(rounds)) == r)
        table = own.toArrow().combine_chunks()
        asked = Asked(*(table.column(i).combine_chunks() if table.num_rows else pa.array([], table.schema.field(i).type) for i in (0, 1)))
        weight = weigh(asked.terms.to_pylist()) if weigh else None
        search = _search(spark.sparkContext.broadcast(asked), len(carry), len(fields), bool(union), weight, rate, limit, [query_key, *names])
        out = read.mapInArrow(search, ", ".join(kinds))
        found.append(out if rounds == 1 else materialise(out, "search-round"))
    return reduce(DataFrame.unionByName, found)
