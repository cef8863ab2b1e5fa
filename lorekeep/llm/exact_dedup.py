"""Exact deduplication with a heavy-hitter split.

Texts are equal when identical after each ``[\\x20\\x09-\\x0D]+`` became one space.
Every text is read once; its SHA-256 digest goes to a written table, and all
further steps read only that. Misra-Gries summaries of ``k`` counters, one a
partition, are added up: a digest with more than 2 N / k rows keeps a summed
count above N / k, and no more than ``k`` digests can. So the candidates number at most
``k`` and are broadcast; their true counts and winners are then computed over
all rows (map-side partial aggregation), and the verified winners, again at
most ``k`` rows, settle every frequent digest without a shuffle. The remaining
digests, none of which has more than 2 N / k rows, go through an ordinary
shuffle.

Defined cases: null text counts as empty, so all null and empty texts are one
group; of equal texts the smallest ``doc_id`` stays (null sorts last); of rows
repeated with the same ``doc_id`` exactly one is kept; very long texts are hashed
whole; an empty table gives an empty result; other columns are ignored by
``exact_dedup`` and kept by ``keep_first``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.storage import materialise, ship

COUNTERS = 1024


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def misra_gries(items: Iterator[bytes], k: int) -> dict[bytes, int]:
    """At most ``k`` counters; each is too low by at most n / (k + 1)."""
    counters: dict[bytes, int] = {}
    for x in items:
        if x in counters:
            counters[x] += 1
        elif len(counters) < k:
            counters[x] = 1
        else:
            for y in list(counters):
                counters[y] -= 1
                if not counters[y]:
                    del counters[y]
    return counters


def _summaries(k: int):
    def run(batches):
        c = misra_gries((x for b in batches for x in b.column(0).to_pylist()), k)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["digest", "low"])

    return run


def frequent(digests: DataFrame, k: int = COUNTERS) -> DataFrame:
    """Verified frequent digests, at most ``k`` rows: (digest, group_size, winner)."""
    ship(digests.sparkSession)
    total = digests.agg(F.count(F.lit(1))).first()[0]
    # Partial counters are worth a single row or two in most partitions' tails;
    # only sums above total / k can belong to a frequent digest.
    candidates = (
        digests.select("digest").mapInArrow(_summaries(k), "digest binary, low long").groupBy("digest").agg(F.sum("low").alias("low")).where(F.col("low") > total / k).select("digest")
    )
    return (
        digests.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), _winner().alias("winner"))
    )


def _winner():
    return F.min(F.struct(F.col("key").isNull().alias("n"), "key", "row"))


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = COUNTERS) -> DataFrame:
    """One row per document: (key, keep_id, group_size, kept, text_sha256)."""
    digests = materialise(
        docs.select(F.col(key).alias("key"), F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest"), F.monotonically_increasing_id().alias("row")),
        "digests",
    )
    hot = materialise(frequent(digests, k), "frequent-digests")
    on_map_side = digests.join(F.broadcast(hot), "digest").select("key", "digest", "row", "group_size", "winner")
    w = Window.partitionBy("digest")
    shuffled = digests.join(F.broadcast(hot.select("digest")), "digest", "left_anti").select("key", "digest", "row", F.count(F.lit(1)).over(w).alias("group_size"), _winner().over(w).alias("winner"))
    return on_map_side.unionByName(shuffled).select(
        F.col("key").alias(key),
        F.col("winner.key").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts: that of the
    least key (nulls last), then of the least row number in a written copy.

    Copies of frequent texts go on the map side, by the broadcast winners. Of the
    rest only the rows' numbers meet by digest; whole rows move once at most,
    for the join with the numbers of those that go."""
    numbered = materialise(
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(key).alias("key"), F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest"), F.monotonically_increasing_id().alias("row")),
        "numbered",
    )
    digests = numbered.select("key", "digest", "row")
    hot = F.broadcast(materialise(frequent(digests, k), "frequent-digests").select("digest", F.col("winner.row").alias("first")))
    cold = digests.join(hot, "digest", "left_anti").select("row", _winner().over(Window.partitionBy("digest")).alias("winner"))
    gone = materialise(cold.where("row <> winner.row").select("row"), "gone")
    stay = numbered.join(hot, "digest", "left").where("first is null or row = first")
    return stay.join(gone, "row", "left_anti").select("doc.*")
