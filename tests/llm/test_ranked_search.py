import math
import os
import random
import re
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import ranked_search
from lorekeep.llm.queries import op13_ranked_search
from tests.llm.common import SF, documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(items, docs, k=10):
    """Rows (item, rank, doc, score), every document scored."""
    held = [(i, words(t)) for i, t in docs]
    n_docs, length = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    often = {}
    for _, w in held:
        for x in set(w):
            often[x] = often.get(x, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, w in held:
            m = 25 + 75 * len(w) * n_docs // max(1, length)
            score = 0
            for x in words(text):
                if tf := w.count(x):
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * often[x] + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_terms(spark):
    texts = ["Ab1 c-D_e", "日本 É é x\x00y", "", None, "ÀB's", "x" * 10]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(ranked_search.terms(F.col("text"))).collect()] == [words(t) for t in texts]


@pytest.mark.parametrize("block", [1 << 20, 64, 1])
def test_counts_of_long_texts(monkeypatch, block):
    """A text that is read in several parts counts as one."""
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    texts = ["a b a. B-a", None, "", " ", "x " * 100 + "a", "-- !", "日本 a日 É"]
    asked = pa.array([b"a", b"b", "日本".encode()], pa.large_binary())
    batch = pa.RecordBatch.from_pydict({"key": list(range(len(texts))), "text": texts})
    got = next(ranked_search._count(SimpleNamespace(value=asked), ["key", "n", "codes", "counts"])([batch])).to_pylist()
    want = [{"key": i, "n": len(words(t)), "codes": [c for c, x in enumerate(("a", "b", "日本")) if x in words(t)], "counts": [words(t).count(x) for x in ("a", "b", "日本") if x in words(t)]} for i, t in enumerate(texts) if words(t)]
    assert got == want


@pytest.mark.parametrize("shard", [1 << 20, 37, 1])
def test_against_brute_force(spark, shard):
    rng = random.Random(shard)
    text = lambda n: " ".join(f"W{min(int(rng.paretovariate(0.7)), 60)}" for _ in range(n))
    docs = [(i, text(rng.randrange(30))) for i in range(250)] + [(700, "w1 w2 w3"), (650, "w1 w2 w3"), (650, "w1 w2 w3"), (None, "w1 w2 w3"), (800, None), (801, ""), (802, " -- "), (803, "w1 " * 5000)]
    items = [(i, text(6)) for i in range(12)] + [(3, "w1 w1 w2"), (3, "w1 w1 w2"), (None, "w3"), (90, ""), (91, None), (92, "absent"), (93, "w1 w2 w3")]
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS number", "2 AS terms", "3 AS score")
    got = rows(ranked_search.ranked_search(q, documents(spark, docs, extra=True).repartition(3), limit=10, shard=shard))
    assert got == sorted(brute_force(items, docs), key=repr)


def test_rounds(spark, monkeypatch):
    rng = random.Random(1)
    text = lambda n: " ".join(f"w{rng.randrange(30)}" for _ in range(n))
    docs, items = [(i, text(12)) for i in range(60)], [(i, text(5)) for i in range(9)]
    monkeypatch.setattr(ranked_search, "MOST_TERMS", 12)
    got = rows(ranked_search.ranked_search(spark.createDataFrame(items, "item_id long, text string"), documents(spark, docs), limit=4))
    assert got == sorted(brute_force(items, docs, 4), key=repr)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = documents(spark, [(1, "a"), (2, "b")])
    assert ranked_search.ranked_search(items.where("item_id < 0"), docs).count() == 0
    assert ranked_search.ranked_search(items, docs.where("doc_id < 0")).count() == 0
    assert ranked_search.ranked_search(items, documents(spark, [(1, None), (2, " ")])).count() == 0


def test_lists_are_left_before_their_end(spark):
    """A rare term decides early: most of the frequent term's list is never read."""
    docs = [(i, "common word" if i % 2 else "common " * 9 + "filler") for i in range(4000)] + [(5000 + i, "rare rare common") for i in range(12)]
    items = spark.createDataFrame([(1, "rare common")], "item_id long, text string")
    found = ranked_search.ranked_candidates(items, documents(spark, docs).coalesce(1), 10, "item_id", "doc_id").collect()
    assert {r.key for r in found} == set(range(5000, 5010))
    assert found[0].read < 200  # of 4,024 postings


def test_equal_scores_at_the_threshold(spark):
    """500 documents tie; the ten of the least keys stay, wherever they stand."""
    docs = [(i, "same words here") for i in range(500, 0, -1)] + [(1000 + i, "others") for i in range(100)]
    items = spark.createDataFrame([(1, "same words")], "item_id long, text string")
    for shard in (1 << 20, 50):
        got = ranked_search.ranked_search(items, documents(spark, docs).repartition(4), shard=shard).collect()
        assert sorted((r["rank"], r.doc_id) for r in got) == [(i, i) for i in range(1, 11)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows(op13_ranked_search(spark, SF)) == sorted(brute_force(items, docs), key=repr)
