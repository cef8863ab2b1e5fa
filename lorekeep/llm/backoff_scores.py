"""Language-model scores by stupid backoff, computed relationally.

A bigram model is counted over the whole corpus and scores every word of it:

    S(w | v) = c(v w) / c(v)     if c(v w) >= ``least``
               0.4 * c(w) / N    otherwise

with v a start mark before a text's first word and c(start) the number of texts that have words. A
document's score is the mean of ln S over its words.

* The unigram table is aggregated first. Its ``heavy`` most frequent words (a
  documented bound) and the start mark are broadcast with their counts.
* Pairs of the ``CORE`` most frequent of those fill a table of fixed size, which is counted
  over all texts and broadcast: no hot pair is ever shuffled.
* All other n-grams are exploded and partitioned by the hash of a key: the word if it is not
  heavy, else the context if that is not, else the pair. There the bigram counts and the counts
  of words that are not heavy are taken and joined to the n-grams by a window over that
  partitioning, so a task holds no more than Spark's sort, which spills. A group of the
  window is at most as large as the least frequent heavy word or core pair.
* A repeated bigram of two words that are not heavy also wants its context's
  count: those few are aggregated and joined with the unigram table.
* Scores are summed per document.

N-grams cross the shuffle as arrays, a row for each task and stretch of texts, and are
exploded behind it. Words are 63-bit hashes, texts are told apart by 64-bit hashes.

Defined cases: null and empty texts have no words and score null; equal
texts score alike, repeated rows are counted each; very long texts are hashed in parts and
scored whole; ties of frequency are broken by hash; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.hashing import mixed, word_hashes
from lorekeep.storage import materialise, ship

HEAVY, CORE = 1 << 16, 256
LEAST, BACKOFF = 2, 0.4
FLUSH = 120_000
#: Codes below 0 are hashes of words, others ranks among the heavy words; the start mark is first.
SIGN = np.uint64(1 << 63)
START = np.int64(-1)


def _coded(hashes: np.ndarray) -> np.ndarray:
    return (hashes | SIGN).view(np.int64)


def _contexts(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The word before each, the start mark before a text's first."""
    before = np.empty(len(words), np.int64)
    before[1:] = words[:-1]
    before[np.concatenate([[0], np.cumsum(counts)[:-1]])[counts > 0]] = START
    return before


def _bigrams(batches):
    """(th of each text, context, word, text index) of many texts at a time."""
    held, size = [], 0

    def joined():
        owners, at = [], 0
        for ids, _, _, counts in held:
            owners.append(np.repeat(np.arange(len(ids)), counts) + at)
            at += len(ids)
        ids, context, word, _ = map(np.concatenate, zip(*held))
        return ids, context, word, np.concatenate(owners)

    for batch in batches:
        ids = batch.column(0).to_numpy()
        for first, hashes, counts in word_hashes(batch.column(1)):
            words = _coded(hashes)
            held.append((ids[first : first + len(counts)], _contexts(words, counts), words, counts))
            size += len(words)
            if size >= FLUSH:
                yield joined()
                held, size = [], 0
    if size:
        yield joined()


def _count_words(batches):
    for _, context, word, _ in _bigrams(batches):
        w, n = np.unique(np.append(word, context[context == START]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(n, pa.int64())], ["w", "n"])


class Heavy:
    """The heavy words, the start mark first, and the sorted search for their ranks."""

    def __init__(self, words: np.ndarray):
        self.order = np.argsort(words)
        self.words = words[self.order]
        self.core = min(CORE, len(words))

    def codes(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.order[at], words)

    def cells(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs are core pairs, and these pairs' cells."""
        inside = (v >= 0) & (v < self.core) & (w >= 0) & (w < self.core)
        return inside, v[inside] * self.core + w[inside]


def _count_core(heavy):
    def run(batches):
        table = heavy.value
        n = np.zeros(table.core**2, np.int64)
        for _, context, word, _ in _bigrams(batches):
            n += np.bincount(table.cells(table.codes(context), table.codes(word))[1], minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at])], ["cell", "n"])

    return run


def _deal(heavy, parts: int):
    names = ["part", "texts", "owner", "v", "w"]

    def lists(values: np.ndarray, cuts: list[int]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values))

    def run(batches):
        table = heavy.value
        for th, context, word, owner in _bigrams(batches):
            v, w = table.codes(context), table.codes(word)
            rest = np.flatnonzero(~table.cells(v, w)[0])
            v, w, owner = v[rest], w[rest], owner[rest]
            key = np.where(w < 0, w, np.where(v < 0, v, (v << 31) + w))
            part = (mixed(key.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            v, w, owner, part = v[order], w[order], owner[order], part[order]
            new_part = np.concatenate([[True], part[1:] != part[:-1]]) if len(part) else np.zeros(0, bool)
            new_text = new_part | np.concatenate([[True], owner[1:] != owner[:-1]])[: len(part)]
            cuts, texts = np.flatnonzero(new_part), np.flatnonzero(new_text)
            place = np.cumsum(new_text) - 1
            first = np.searchsorted(texts, cuts)
            within = place - np.repeat(first, np.diff(np.append(cuts, len(part))))
            ends = [*cuts.tolist(), len(part)]
            columns = [pa.array(part[cuts], pa.int32()), lists(th[owner[texts]], [*first.tolist(), len(texts)]), lists(within.astype(np.int32), ends), lists(v, ends), lists(w, ends)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _documents(heavy, core):
    """What is known of each document without a shuffle: its words, those not in core
    pairs, and the sum of scores and the backoffs of its core pairs."""
    names = ["key", "th", "n_words", "rest", "s", "b"]

    def run(batches):
        table, (score, backed) = heavy.value, core.value
        for batch in batches:
            out = [np.zeros(batch.num_rows, kind) for kind in (np.int64, np.int64, np.float64, np.int64)]
            for first, hashes, counts in word_hashes(batch.column(2)):
                words = _coded(hashes)
                inside, cells = table.cells(table.codes(_contexts(words, counts)), table.codes(words))
                owner, k, at = np.repeat(np.arange(len(counts)), counts), len(counts), slice(first, first + len(counts))
                out[0][at] = counts
                out[1][at] = counts - np.bincount(owner[inside], minlength=k)
                out[2][at] = np.bincount(owner[inside], score[cells], k)
                out[3][at] = np.bincount(owner[inside], backed[cells], k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out)], names)

    return run


def ngram_scores(texts: DataFrame, heavy, logs: DataFrame, total: float, least: int, backoff: float) -> DataFrame:
    """(th, v, s, n, b): for each text the sums over its n-grams of one task. Where ``v`` is
    not null, the log of that word's count is still to be taken off ``k`` times."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.mapInArrow(_deal(heavy, parts), "part int, texts array<bigint>, owner array<int>, v array<bigint>, w array<bigint>")
    rows = dealt.repartition(parts, "part").select("part", "texts", F.inline(F.arrays_zip("owner", "v", "w"))).select("part", F.get("texts", "owner").alias("th"), "v", "w")
    keyed = rows.withColumn("key", F.when(F.col("w") < 0, F.col("w")).when(F.col("v") < 0, F.col("v")).otherwise(F.shiftleft("v", 31) + F.col("w")))
    # One sort serves both windows; the key comes first because Spark sorts by the first column's bits.
    counted = keyed.sortWithinPartitions("key", "part", "v", "w").withColumn("alone", F.sum(F.when(F.col("w") == F.col("key"), 1)).over(Window.partitionBy("key", "part")))
    counted = counted.withColumn("pair", F.count(F.lit(1)).over(Window.partitionBy("key", "part", "v", "w")))
    known = logs.scalar()

    def log_count(word: str) -> Column:
        return F.when(F.col(word) >= 0, F.get(known, F.col(word).cast("int"))).otherwise(F.log("alone"))

    seen = F.col("pair") >= least
    asked = seen & (F.col("v") < 0) & (F.col("w") < 0)
    score = F.when(asked, F.log("pair")).when(seen, F.log("pair") - log_count("v")).otherwise(log_count("w") + math.log(backoff) - math.log(total))
    scored = counted.select("part", "th", F.when(asked, F.col("v")).alias("v"), score.alias("s"), (~seen).cast("long").alias("b"))
    return scored.groupBy("part", "th", "v").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).drop("part")


def backoff_scores(docs: DataFrame, text: str = "text", key: str = "doc_id", heavy: int = HEAVY, least: int = LEAST, backoff: float = BACKOFF) -> DataFrame:
    """One row a document: (key, n_words, n_backoff, score); score is the mean ln S."""
    spark = docs.sparkSession
    ship(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("th"), body.alias("text"))
    texts = keyed.select("th", "text")
    unigrams = materialise(texts.mapInArrow(_count_words, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")), "unigrams")
    words = unigrams.where(F.col("w") != int(START))
    total = words.agg(F.sum("n")).first()[0] or 1
    starts = unigrams.where(F.col("w") == int(START)).agg(F.sum("n")).first()[0] or 1
    top = words.orderBy(F.col("n").desc(), "w").limit(heavy).toArrow()
    table = Heavy(np.append(START, top["w"].to_numpy()))
    shared = spark.sparkContext.broadcast(table)
    log = np.log(np.append(starts, top["n"].to_numpy()).astype(float))

    cells = texts.mapInArrow(_count_core(shared), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(table.core**2)
    n[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    v, w = np.divmod(np.arange(len(n)), table.core)
    core = np.where(n >= least, np.log(np.maximum(n, 1)) - log[v], math.log(backoff) + log[w] - math.log(total)), n < least

    logs = spark.createDataFrame([(log.tolist(),)], "logs array<double>")
    partial = materialise(ngram_scores(texts, shared, logs, total, least, backoff), "partial-scores")
    contexts = unigrams.select(F.col("w").alias("v"), F.log("n").alias("l"))
    asked = partial.where("v is not null").join(contexts, "v").select("th", (F.col("s") - F.col("n") * F.col("l")).alias("s"), "n", "b")
    sums = partial.where("v is null").select("th", "s", "n", "b").unionByName(asked).groupBy("th").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("b").alias("b"))
    kind = docs.schema[key].dataType.simpleString()
    known = keyed.mapInArrow(_documents(shared, spark.sparkContext.broadcast(core)), f"key {kind}, th bigint, n_words bigint, rest bigint, s double, b bigint")
    both = known.withColumnsRenamed({"s": "s0", "b": "b0"}).join(sums, "th", "left")
    # Equal texts share their sums over n-grams; n holds all copies' n-grams.
    own = F.when(F.col("n") > 0, F.col("rest") / F.col("n")).otherwise(0.0)
    return both.select(
        F.col("key").alias(key),
        "n_words",
        (F.col("b0") + F.coalesce(F.round(F.col("b") * own), F.lit(0.0)).cast("long")).alias("n_backoff"),
        F.when(F.col("n_words") > 0, F.round((F.col("s0") + F.coalesce(F.col("s") * own, F.lit(0.0))) / F.col("n_words"), 6)).alias("score"),
    )
