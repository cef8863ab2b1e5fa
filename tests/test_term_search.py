import random
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import functions as F

from lorekeep.operators import lexical, term_search


def jaccard(a, b):
    return round(len(a & b) / len(a | b), 6) if a | b else 0.0


def test_rounds_and_ties_give_the_best_of_all(spark, monkeypatch):
    rng = random.Random(6)
    text = lambda n: " ".join(f"word{rng.randrange(40)}" for _ in range(n))
    docs = [(i, text(rng.randrange(12))) for i in range(300)] + [(900, None), (901, "")]
    queries = [(i, text(5)) for i in range(23)] + [(50, ""), (51, None)]
    q, d = spark.createDataFrame(queries, "q int, text string"), spark.createDataFrame(docs, "id int, text string")
    want = []
    for k, t in queries:
        own = set((t or "").split())
        scored = sorted((-jaccard(own, set((x or "").split())), i) for i, x in docs if own & set((x or "").split()))[:4]
        want += [(k, i, -s, r + 1) for r, (s, i) in enumerate(scored)]
    for terms, cells in ((1_000_000, 1 << 20), (40, 100)):
        monkeypatch.setattr(term_search, "MOST_TERMS", terms)
        monkeypatch.setattr(term_search, "CELLS", cells)
        assert sorted(tuple(r) for r in lexical.best_jaccard(q, d.repartition(3), "q", "id", limit=4).collect()) == sorted(want)
    assert lexical.best_jaccard(q.where("q < 0"), d, "q", "id").count() == 0
    assert lexical.bm25(q, d.where(F.lit(False)), "q", "id", 3).count() == 0


def test_a_step_scores_a_bounded_number_of_pairs(monkeypatch):
    """Terms that every query asks for make as many pairs as documents times queries times terms."""
    seen, hits = [], term_search.Asked.hits
    monkeypatch.setattr(term_search.Asked, "hits", lambda self, row, code, *a: seen.append(int(self.count[code].sum())) or hits(self, row, code, *a))
    monkeypatch.setattr(term_search, "CELLS", 1000)
    words = [f"w{i}" for i in range(20)]
    lists = lambda n: pa.array([words] * n)
    asked = term_search.Asked(pa.array(range(10)), lists(10))
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), lists(50)], ["id", "list"])
    run = term_search._search(SimpleNamespace(value=asked), 1, 1, False, None, lambda h, sizes, part: (h[0], h[0]), 50, ["q", "id", "hits"])
    out = pa.Table.from_batches(run([batch]))
    assert out.num_rows == 500 and set(out.column("hits").to_pylist()) == {20.0} and max(seen) <= 1000 and sum(seen) == 50 * 200
