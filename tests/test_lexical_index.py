import math
import random

import numpy as np
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import lexical, lexical_index
from lorekeep.plans import indexes
from lorekeep.storage import new_path

SF = "/root/testdata/sf0.001"


def brute_bm25(queries, docs, k):
    held = [(i, [w for w in (t or "").split()]) for i, t in docs]
    n, average = len(held), sum(len(w) for _, w in held) / max(1, len(held))
    out = []
    for q, text in queries:
        scored = []
        for i, words in held:
            s = 0.0
            for w in set((text or "").split()):
                if tf := words.count(w):
                    df = sum(w in x for _, x in held)
                    s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / average))
            if s > 0:
                scored.append((-round(s, 6), i))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def corpus(rng, n):
    word = lambda: f"word{min(int(rng.paretovariate(0.6)), 80)}"
    return [(i, " ".join(word() for _ in range(rng.randrange(25)))) for i in range(n)] + [(9000, None), (9001, "")]


def test_one_index_answers_many_searches(spark):
    rng = random.Random(4)
    docs = corpus(rng, 400)
    path = new_path(spark, "test-index")
    lexical.write_bm25_index(spark.createDataFrame(docs, "id int, text string").repartition(5), "id", path)
    index = lexical_index.LexicalIndex.open(spark, path)
    assert index.units.count() == 402
    for seed in range(2):
        queries = [(i, " ".join(f"word{rng.randrange(1, 80)}" for _ in range(7))) for i in range(8)] + [(90, ""), (91, None), (92, "absent")]
        got = lexical.search_bm25(spark.createDataFrame(queries, "q int, text string"), index, "q", "id", 6).collect()
        assert sorted((r.q, r.id, r.score, r["rank"]) for r in got) == brute_bm25(queries, docs, 6)


def test_rounds_of_queries(spark, monkeypatch):
    rng = random.Random(8)
    docs, queries = corpus(rng, 60), [(i, f"word{i} word1 word{i + 1}") for i in range(9)]
    monkeypatch.setattr(lexical_index, "MOST_TERMS", 6)
    got = lexical.bm25(spark.createDataFrame(queries, "q int, text string"), spark.createDataFrame(docs, "id int, text string"), "q", "id", 4).collect()
    assert sorted((r.q, r.id, r.score, r["rank"]) for r in got) == brute_bm25(queries, docs, 4)


def test_blocks_that_cannot_win_are_not_scored(spark):
    """A term of every unit and one of a few units: only the few's blocks are scored."""
    docs = [(i, "common " + "filler " * (5 + i % 7)) for i in range(8000)] + [(8000 + i, "rare rare common") for i in range(10)]
    index = lexical.write_bm25_index(spark.createDataFrame(docs, "id int, text string").coalesce(1).sortWithinPartitions("id"), "id", new_path(spark, "test-index"))
    assert index.postings.select("shard").distinct().count() == 1
    queries = spark.createDataFrame([(1, "rare common")], "q int, text string")
    found = lexical_index.candidates(index, queries, "q", T.token_set(F.col("text")), 10, weigh=lambda df: np.log(1 + (8010 - df + 0.5) / (df + 0.5))).collect()
    assert {r.unit for r in found} >= set(range(8000, 8010))
    assert found[0].scored < 600  # of 8,020 postings of the two terms
    best = lexical.search_bm25(queries, index, "q", "id", 10).collect()
    assert sorted(r.id for r in best) == list(range(8000, 8010))


def test_no_list_is_longer_than_a_shard(spark):
    docs = spark.range(20_000).select("id", F.lit("everywhere").alias("text")).coalesce(1)
    index = lexical.write_bm25_index(docs, "id", new_path(spark, "test-index"))
    sizes = index.postings.select("shard", F.aggregate("blocks", F.lit(0), lambda n, b: n + F.size(b["postings"])).alias("n")).collect()
    assert sorted((r.shard, r.n) for r in sizes) == [(0, 8192), (1, 8192), (2, 20_000 - 16_384)]


def test_field_scores_against_a_loop(spark):
    rng = random.Random(11)
    word = lambda: f"term{rng.randrange(30)}"
    pages = [(i, f"dir/{word()}", word(), f"{word()} {word()}" if i % 3 else "x" * 2000, "\n".join(" ".join(word() for _ in range(6)) for _ in range(3))) for i in range(200)] + [(500, "dir/none", None, None, None)]
    queries = [(i, " ".join(word() for _ in range(5))) for i in range(12)] + [(50, None)]
    import re

    def score(q, page):
        _, path, title, description, content = page
        fields = [(path, 2.2), (title, 2.0), (description or "", 1.0), ((content or "")[:500], 0.6)]
        full = "\n".join(t for t, _ in fields if t is not None).lower()
        words = lambda t: set(re.findall(r"[a-z0-9]{3,}", (t or "").lower()))
        asked = list(dict.fromkeys((q or "").split()))
        m = [w for w in asked if w in words(full)]
        if not m:
            return 0.0
        base = sum(sum(w in words(t) for w in asked) / len(asked) * x for t, x in fields) + len(m) / len(asked) * 0.4
        bonus = 0.0 if len(m) < 2 else 1.0 if any(re.search(rf"{a}[^a-z0-9]+{b}", full) for a, b in zip(m, m[1:])) else min(0.75, len(m) / len(asked))
        n = len(description or "")
        return round((base + 0.25 * bonus) * (1.0 if n <= 1500 else max(0.55, 1500 / n)), 6)

    want = []
    for k, q in queries:
        scored = sorted((-score(q, p), p[0]) for p in pages if score(q, p) > 0)[:5]
        want += [(k, i, -s, r + 1) for r, (s, i) in enumerate(scored)]
    made = spark.createDataFrame(pages, "id int, path string, title string, description string, content string").repartition(3)
    got = lexical.lexical_pages(spark.createDataFrame(queries, "q int, text string"), made, "q", 5).collect()
    assert sorted((r.q, r.id, r.score, r["rank"]) for r in got) == sorted(want)


def test_empty_index(spark):
    docs = spark.createDataFrame([], "id int, text string")
    index = lexical.write_bm25_index(docs, "id", new_path(spark, "test-index"))
    assert lexical.search_bm25(spark.createDataFrame([(1, "a word")], "q int, text string"), index, "q", "id", 3).count() == 0


def test_an_index_is_written_once(spark):
    first, again = indexes.document_index(spark, SF), indexes.document_index(spark, SF)
    assert first.postings.inputFiles() == again.postings.inputFiles()


def test_units_are_dealt_once_and_written_once(spark):
    """Postings are made where a shard lies, and an index holds a text's words once."""
    units = spark.createDataFrame([(i, 3, ["a", f"w{i}", "a"]) for i in range(9000)], "unit long, length int, terms array<string>")
    made = lexical_index.postings(units, "length", [F.col("terms")], lambda tf, n: tf[0] / n)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    rows = {(r.term, r.shard): r.blocks for r in made.where("term in ('a', 'w8200')").collect()}
    assert {k: sum(len(b.postings) for b in v) for k, v in rows.items()} == {("a", 0): 8192, ("a", 1): 808, ("w8200", 1): 1}
    assert [(p.local, p.value) for p in rows["w8200", 1][0].postings] == [(8, 1 / 3)] and rows["a", 1][0].top == 2 / 3
    pages = spark.createDataFrame([(1, "a/b", "One,  two", None, "Three")], "id int, path string, title string, description string, content string")
    index = lexical.write_field_index(lexical.page_units(pages), lexical.PAGE_SCORES, new_path(spark, "test-index"))
    assert index.units.drop("unit").first().asDict() == {"id": 1, "path": "a/b", "f_path": "a b", "f_title": "one two", "f_description": None, "f_body": "three", "penalty": 1.0}
