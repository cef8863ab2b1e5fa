"""Ranked lexical search by Fagin's threshold algorithm.

1. Every document's terms that some item asks for are counted where the text is read
   and written once: (key, number of terms, codes, counts), the forward index.
2. Its rows give the corpus' statistics (documents, their terms, documents of a term).
3. Each task reads its part of the forward index in shards of a bounded number of postings. A
   shard has, for each term, its documents in the order of the term's impact on the score.
   An item's lists are read in turn, all to the same depth; a document that turns up
   is scored at once by its own row of the forward index. The item is done when the sum of
   what its lists could still add, the threshold, falls strictly below the kth best score (of
   this shard or the task's earlier ones), so that no tie is lost.
4. What is left, at most k rows an item and shard, is ranked in two steps, so that no task
   gathers an item's rows from all shards.

A term that a third of all documents hold has a list in every shard, none of them
longer than the shard. The items' terms are broadcast, at most ``MOST_TERMS`` in a round;
more items take more rounds.

Defined cases: a null or empty text, in items or documents, has no terms; such an item
has no results, such a document is never one. Each row is an item or document of
its own, repeated ones too. Equal scores rank by ascending key, null keys last. Very long texts
are read whole. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.hashing import LOWER, text_bytes, text_parts
from lorekeep.storage import materialise, ship

#: Distinct terms of items in a round, bytes of text split together, postings of a shard, the
#: first depth to which lists are read (then twice as deep each time), spread of the first ranking.
MOST_TERMS, BLOCK, SHARD, FIRST, SPREAD = 1_000_000, 4 << 20, 1 << 20, 16, 64
#: The weights of a count and of the length, in hundredths and thousandths.
LENGTH_SHARE, SCALE, UNIT, DAMPING = 75, 1000, 1_000_000_000, 8
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INSIDE = np.ones(256, bool)
INSIDE[:128] = [chr(i).isalnum() for i in range(128)]
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """All terms of a text, in order: letters and digits of ASCII (A-Z lower-cased) and
    all signs beyond it."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, SMALL), F.lit(TERM), 0)


def _count(asked, keys: list[str]):
    """Rows of the forward index of batches of (key, text)."""

    def run(batches):
        held: pa.Array = asked.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            total, found = np.zeros(batch.num_rows, np.int64), []
            for parts in text_parts(data, offsets, BLOCK):
                part = np.concatenate([data[a:b] for _, a, b in parts])
                cuts = np.concatenate([[0], np.cumsum([b - a for _, a, b in parts])])
                inside = INSIDE[part]
                first = inside.copy()
                first[1:] &= ~inside[:-1]
                heads = cuts[:-1]
                first[heads] = inside[heads]
                starts = np.flatnonzero(first)
                # Without what lies between them the terms follow each other.
                ends = np.append(np.cumsum(inside)[starts] - 1, np.count_nonzero(inside))
                words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(LOWER[part[inside]])])
                code = pc.index_in(words, value_set=held).fill_null(-1).to_numpy(zero_copy_only=False)
                row = np.array([r for r, _, _ in parts], np.int64)[np.searchsorted(heads, starts, "right") - 1]
                total += np.bincount(row, minlength=len(total))
                found.append(np.stack(np.unique((row * len(held) + code)[code >= 0], return_counts=True)))
            pair, often = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
            pair, where = np.unique(pair, return_inverse=True)  # a long text has several parts
            often = np.bincount(where, often, len(pair)).astype(np.int64)
            row, code = np.divmod(pair, max(1, len(held)))
            some = np.flatnonzero(total)
            at = pa.array(np.append(np.searchsorted(row, some), len(row)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x, kind)) for x, kind in ((code, pa.int32()), (often, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(total[some]), *lists], keys)

    return run


@dataclass
class Items:
    """The items of a round: their keys, distinct term codes and how often each is asked."""

    keys: pa.Array
    codes: list[np.ndarray]
    times: list[np.ndarray]
    weights: np.ndarray
    documents: int
    length: int

    def impacts(self, code: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - LENGTH_SHARE + LENGTH_SHARE * n * self.documents // self.length
        return self.weights[code] * (UNIT * tf // (SCALE * tf + DAMPING * m))


class Shard:
    """Some documents: by document the impacts of their terms, by term its documents in
    descending order of impact."""

    def __init__(self, items: Items, keys: pa.Array, sizes: np.ndarray, n: np.ndarray, code: np.ndarray, tf: np.ndarray):
        self.keys, self.code = keys, code
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.repeat(np.arange(len(keys)), sizes)
        self.impact = items.impacts(code, tf, n[owner])
        order = np.lexsort((-self.impact, code))
        self.listed, self.falling = owner[order], self.impact[order]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(items.weights)))])
        # Ties rank by key, null keys last.
        self.place = np.empty(len(keys), np.int64)
        self.place[pc.array_sort_indices(keys).to_numpy()] = np.arange(len(keys))
        self.seen = np.full(len(keys), -1, np.int64)
        self.asked = np.zeros(len(items.weights), np.int64)
        self.read = 0

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores of documents, by their rows of the forward index (none is empty)."""
        sizes = self.at[docs + 1] - self.at[docs]
        first = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) + np.repeat(self.at[docs] - first, sizes)
        return np.add.reduceat(self.asked[self.code[place]] * self.impact[place], first)

    def best(self, item: int, codes: np.ndarray, times: np.ndarray, k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the ``k`` best of an item. A score below ``bar`` is of no use."""
        self.asked[codes] = times
        head, end = self.ends[codes], self.ends[codes + 1]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth = FIRST
        while True:
            stop = np.minimum(head + depth, end)
            sizes = stop - head
            place = np.arange(sizes.sum()) + np.repeat(head - (np.cumsum(sizes) - sizes), sizes)
            self.read += len(place)
            new = self.listed[place]
            new = np.unique(new[self.seen[new] != item])
            if len(new):
                self.seen[new] = item
                docs, scores = np.concatenate([docs, new]), np.concatenate([scores, self.scores(new)])
                order = np.lexsort((self.place[docs], -scores))[:k]
                docs, scores = docs[order], scores[order]
            head, depth = stop, 2 * depth
            live = head < end
            threshold = int((times[live] * self.falling[head[live]]).sum())
            reached = max(bar, int(scores[-1]) if len(scores) == k else 0)
            if not live.any() or threshold < reached:
                break
        self.asked[codes] = 0
        good = (scores > 0) & (scores >= bar)
        return docs[good], scores[good]


def _search(items, k: int, names: list[str], shard: int):
    def run(batches):
        its: Items = items.value
        bars = np.zeros((len(its.keys), k), np.int64)  # each item's best scores so far
        held, size = [], 0

        def found():
            columns = [pa.concat_arrays([b.column(c) for b in held]) for c in range(4)]
            counts = pc.list_value_length(columns[2]).to_numpy(zero_copy_only=False).astype(np.int64)
            some = np.flatnonzero(counts)  # documents that hold no asked term have no score
            s = Shard(its, columns[0].take(pa.array(some)), counts[some], columns[1].to_numpy()[some], columns[2].flatten().to_numpy(), columns[3].flatten().to_numpy())
            out = []
            for i, (codes, times) in enumerate(zip(its.codes, its.times)):
                if len(codes):
                    docs, scores = s.best(i, codes, times, k, int(bars[i].min()))
                    bars[i] = np.sort(np.concatenate([bars[i], scores]))[-k:]
                    out.append((np.full(len(docs), i), docs, scores))
            item, docs, scores = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 3
            columns = [pa.array(item), its.keys.take(pa.array(item)), s.keys.take(pa.array(docs)), pa.array(scores), pa.array(np.full(len(item), s.read))]
            return pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            at = 0
            ends = np.cumsum(pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False))
            while at < b.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + shard - size, "right")))
                held.append(b.slice(at, to - at))
                size, at = size + int(ends[to - 1]) - before, to
                if size >= shard or at < b.num_rows:
                    yield found()
                    held, size = [], 0
        if held:
            yield found()

    return run


def forward_index(docs: DataFrame, asked: pa.Array, key: str, text: str) -> DataFrame:
    """(key, n, codes, counts) of each document with a term: its number of terms, and the
    places in ``asked`` (sorted bytes) of those that it holds, with their counts. Written once."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    made = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_count(spark.sparkContext.broadcast(asked), ["key", "n", "codes", "counts"]), f"key {kind}, n bigint, codes array<int>, counts array<bigint>")
    return materialise(made, "forward-index")


def ranked_candidates(items: DataFrame, docs: DataFrame, limit: int, item_key: str, key: str, item_text: str = "text", text: str = "text", shard: int = SHARD) -> DataFrame:
    """(item number, item key, key, score, read): the best documents of each item of each
    shard, with the number of postings that the shard read for all its items."""
    spark = docs.sparkSession
    ship(spark)
    listed = items.select(F.col(item_key).alias("item"), terms(F.col(item_text)).alias("terms"))
    size = listed.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    rounds = max(1, -(-size // MOST_TERMS))
    names = ["number", "item", "key", "score", "read"]
    schema = f"number bigint, item {items.schema[item_key].dataType.simpleString()}, key {docs.schema[key].dataType.simpleString()}, score bigint, read bigint"
    found = []
    for r in range(rounds):
        own = listed if rounds == 1 else listed.where(F.pmod(F.xxhash64("item", "terms"), F.lit(rounds)) == r)
        table = own.toArrow().combine_chunks()
        keys, lists = (table.column(i).combine_chunks() if table.num_rows else pa.array([], table.schema.field(i).type) for i in (0, 1))
        coded = lists.flatten().cast(pa.large_binary()).dictionary_encode()
        asked, ends = coded.dictionary, np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        code = coded.indices.to_numpy()
        pairs = [np.unique(code[i:j], return_counts=True) for i, j in zip(ends[:-1], ends[1:])]
        forward = forward_index(docs, asked, key, text)
        documents, length = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        often = np.zeros(len(asked), np.int64)
        for c, n in forward.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1))).collect():  # at most one row a term of the round
            often[c] = n
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in often.tolist()], np.int64)
        shared = spark.sparkContext.broadcast(Items(keys, [p[0] for p in pairs], [p[1] for p in pairs], weights, documents, length))
        out = forward.mapInArrow(_search(shared, limit, names, shard), schema)
        found.append(out if rounds == 1 else materialise(out.withColumn("number", F.col("number") * rounds + r), "search-round"))
    return reduce(DataFrame.unionByName, found)


def ranked_search(items: DataFrame, docs: DataFrame, limit: int = 10, item_key: str = "item_id", key: str = "doc_id", item_text: str = "text", text: str = "text", shard: int = SHARD) -> DataFrame:
    """(item key, rank, key, score): the ``limit`` best documents of each item."""
    found = ranked_candidates(items, docs, limit, item_key, key, item_text, text, shard)
    best = [F.col("score").desc(), F.col("key").asc_nulls_last()]
    spread = found.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(SPREAD)))
    for own in (["number", "part"], ["number"]):
        spread = spread.withColumn("rank", F.row_number().over(Window.partitionBy(*own).orderBy(*best))).where(F.col("rank") <= limit)
    return spread.select(F.col("item").alias(item_key), "rank", F.col("key").alias(key), "score")
