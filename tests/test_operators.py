import math
import random

import numpy as np
from pyspark.sql import functions as F

from lorekeep.functions import paths as P
from lorekeep.functions import text as T
from lorekeep.operators import context, graph, lexical, maintenance, ranking, vectors


def column(spark, f, *values):
    df = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))] if all(v is not None for v in values) else "c0 string")
    return df.select(f(*[F.col(c) for c in df.columns]).alias("x")).first().x


def test_text_functions(spark):
    assert column(spark, T.tokens, "The a1 of Straße, ab cd abc ABC") == ["a1", "straße", "abc", "abc"]
    assert column(spark, T.content_hash, "hello") == "fnv1a:4f9f2cab" and column(spark, T.content_hash, None) == "fnv1a:811c9dc5"
    units = "a😀".encode("utf-16-be")
    h = 0x811C9DC5
    for i in range(0, len(units), 2):
        h = ((h ^ int.from_bytes(units[i : i + 2], "big")) * 0x01000193) & 0xFFFFFFFF
    assert column(spark, T.fnv1a, "a😀") == f"{h:08x}"
    assert column(spark, T.source_body, "---\na: b\n---\nbody \n\n") == "body"
    assert column(spark, T.tag, " #Foo Bar/Baz/ ") == "foo-bar/baz"
    m = column(spark, T.measure_text, "ab 12!!\nпривет漢")
    assert math.isclose(m.raw, 6 / 3.5 + 1 + 3 / 8.1 + 4 / 2.1 + 3 * 1.1) and m.bytes == 8 + 12 + 3
    windows = column(spark, lambda t: T.sliding_windows(t, 10, 4), "x" * 23)
    assert [(w.start, len(w.text)) for w in windows] == [(0, 10), (6, 10), (12, 10), (18, 5)]
    assert column(spark, lambda t: T.sliding_windows(t, 10, 4), "") == []
    assert column(spark, lambda t: T.excerpt(F.array(F.lit("zeta")), t, 12), "alpha beta gamma zeta eta") == "mma zeta eta"
    assert column(spark, T.urls, "see http://a.io/x, (https://b.c/d).") == ["http://a.io/x", "https://b.c/d"]
    assert column(spark, lambda v: T.clamp_int(v, 5, 1, 9), "x") == 5 and column(spark, lambda v: T.clamp_int(v, 5, 1, 9), "12.7") == 9


def test_paths(spark):
    assert column(spark, P.page_id, "a/b.md") == "b" and column(spark, P.source_stem, "a/b.MD") == "b"
    assert column(spark, P.is_page_path, "x/_index.md") is False and column(spark, P.is_page_path, "x/y.md") is True
    assert column(spark, lambda p: P.is_valid_article(p, F.lit("!Wiki/d")), "!Wiki/d/t/p.md") is True
    assert column(spark, lambda p: P.is_valid_article(p, F.lit("!Wiki/d")), "!Wiki/d/p.md") is False
    assert column(spark, lambda n: P.stem(F.lit("d"), n), "ÉcoleHTTPServer x") == "wiki_d_ecole_http_server_x"
    assert column(spark, lambda s: P.is_stem(s), "wiki_a-b_c_d") is True and column(spark, lambda s: P.is_stem(s, "q"), "wiki_a_c") is False
    assert tuple(column(spark, P.id_parts, "DWM-88393 x")) == ("dwm", "88393")


def test_bm25_prefers_rare_terms(spark):
    docs = spark.createDataFrame([("a", "common common rare1x"), ("b", "common other words"), ("c", ""), ("d", None)], "id string, text string")
    queries = spark.createDataFrame([(1, "rare1x common rare1x"), (2, ""), (3, "nothing")], "q int, text string")
    rows = lexical.bm25(queries, docs, "q", "id", 5).collect()
    assert [(r.q, r.id, r["rank"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, "a", 1), (1, "b", 2)]


def test_lexical_scores(spark):
    pages = spark.createDataFrame([("p1", "d/p1", "Solar panel", "about panels", "---\nx: 1\n---\n# T\nsolar panel power"), ("p2", "d/p2", "Other", "", "solar then panel"), ("p3", "d/p3", "", None, "")], "id string, path string, title string, description string, content string")
    queries = spark.createDataFrame([(1, "solar panel")], "q int, text string")
    rows = {r.id: r.score for r in lexical.lexical_pages(queries, pages, "q", 5).collect()}
    # p1: title and body cover both words, exact hits all, adjacent words.
    assert rows == {"p1": round(2.0 + 0.6 + 0.4 + 0.25, 6), "p2": round(0.6 + 0.4 + 0.75 * 0.25, 6)}
    seeds = {r.id: r.score for r in lexical.select_seeds(queries, pages, "q").collect()}
    assert set(seeds) == {"p1", "p2"} and all(0.1 <= s <= 1 for s in seeds.values())


def test_rrf_and_demotion(spark):
    lists = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "b", 2), (1, 1, "b", 1), (1, 1, "c", 2)], "q int, list_no int, id string, rank int")
    assert [(r.id, r["rank"]) for r in ranking.rrf(lists, ["q"], "id").orderBy("rank").collect()] == [("b", 1), ("a", 2), ("c", 3)]
    ranked = spark.createDataFrame([(1, i, i == 1) for i in range(1, 6)], "q int, rank int, boiler boolean").withColumn("id", F.col("rank"))
    moved = ranking.demote(ranked, ["q"], F.col("boiler"), 5, 0.15).orderBy("rank").collect()
    assert [r.id for r in moved] == [2, 1, 3, 4, 5] or [r.id for r in moved][:2] == [2, 3]
    assert [r.id for r in ranking.demote(ranked, ["q"], F.col("boiler"), 2, enabled=False).orderBy("rank").collect()] == [1, 2]


def test_gold_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "q int, id string, rank int")
    gold = spark.createDataFrame([(1, "b", 3), (1, "x", 1), (2, "a", 2)], "q int, id string, grade int")
    rows = {r.q: (r.recall, r.ndcg, r.mrr) for r in ranking.gold_metrics(ranked, gold, "q", "id", 3).collect()}
    ideal = 7 / math.log2(2) + 1 / math.log2(3)
    assert rows == {1: (0.5, round(7 / math.log2(3) / ideal, 6), 0.5), 2: (0.0, 0.0, 0.0)}


def test_guarded_rerank(spark):
    rows = [(1, f"p{i}", i + 1, 0.9 - i * 0.01, s) for i, s in enumerate([0.1, 0.9, 0.2, None])]
    ranked = spark.createDataFrame(rows, "q int, article string, rank int, base double, score double")
    out = ranking.guarded_rerank(ranked, ["q"], "article", "base", "score", 10).orderBy("place").collect()
    assert [r.article for r in out] == ["p1", "p0", "p2", "p3"]
    strict = ranking.guarded_rerank(ranked, ["q"], "article", "base", "score", 2, least_gap=2.0).orderBy("place").collect()
    assert [r.article for r in strict] == ["p0", "p1"]
    two = spark.createDataFrame([(1, "a", 1, 0.9, 0.5), (1, "a", 2, 0.8, 0.4), (1, "b", 3, 0.7, 0.3)], "q int, article string, rank int, base double, score double")
    assert [(r.article, r["rank"]) for r in ranking.guarded_rerank(two, ["q"], "article", "base", "score", 9).orderBy("place").collect()] == [("a", 1), ("b", 3), ("a", 2)]


def test_percentiles(spark):
    row = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double").agg(
        ranking.percentile_linear("v", 0.05).alias("a"), ranking.percentile_floor("v", 0.5).alias("b"), ranking.percentile_nearest("v", 0.95).alias("c")
    ).first()
    assert (round(row.a, 9), row.b, row.c) == (1.15, 3.0, 4.0)


def test_graph_follows_phantom_seeds(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("lone",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "ghost"), ("c", "ghost"), ("b", "a")], "src string, dst string")
    hops = lambda s, d: {r.id: r.hop for r in graph.bfs(spark.createDataFrame([(s,)], "id string"), nodes, edges, d).collect()}
    assert hops("a", 1) == {"a": 0, "b": 1} and hops("ghost", 1) == {"ghost": 0, "b": 1, "c": 1}
    assert hops("c", 3) == {"c": 0}  # a phantom is not reached going forward
    assert {r.id: r.in_degree for r in graph.in_degree(nodes, edges).collect()} == {"a": 1, "b": 1, "c": 0, "ghost": 2, "lone": 0}
    assert [r.id for r in graph.isolated(nodes, edges).collect()] == ["lone"] and graph.unreciprocated(nodes, edges).count() == 0
    pages = spark.createDataFrame([("p", "[[ x ]] [[a/b|c]] [[x#y]] [[]] [[x"), ("q", None)], "id string, text string")
    assert {(r.src, r.dst) for r in graph.link_edges(pages, "id", "text").collect()} == {("p", "x"), ("p", "a/b")}


def test_pooled_scores_in_rounds(spark, monkeypatch):
    """Rounds of few queries and slices of fewer give what one round gives; unusable and other-sized vectors score nothing."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(4).tolist(), f"g{i % 3}" if i % 7 else None) for i in range(1500)] + [(1500, [1.0, 2.0], "g0"), (1505, None, "g1"), (1510, [], "g2")]
    df = spark.createDataFrame(rows, "id long, v array<double>, g string").repartition(4)
    q = df.where("id % 5 = 0")
    x = vectors.unit(np.array([v for _, v, _ in rows[:1500]]))
    scores, of = x @ x.T, np.array([str(g) for _, _, g in rows[:1500]])
    want = {(i, None if g == "None" else g): max(0.0, scores[i][of == g].max()) for i in range(0, 1500, 5) for g in set(of)}
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 8 * 4 * 280)  # rounds of 280 and 20, the first in two slices
    got = {(r.query, r.group): r.cosine for r in vectors.max_pooled(q, df, "id", "v", "g").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert vectors.similarities(q, df, "id", "v").count() == 300 * 1500
    assert vectors.max_pooled(q.where("false"), df, "id", "v", "g").count() == 0


def test_cosine_and_floor(spark):
    assert column(spark, lambda a, b: vectors.cosine(a, b), [1.0, 0.0], [0.0, 0.0]) == 0
    scored = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.5), (1, "c", 0.1), (1, "d", None), (2, "e", 0.3), (2, "f", 0.3)], "q int, id string, s double")
    kept = {r.id for r in vectors.prune_by_floor(scored, ["q"], "s").where("keep").collect()}
    assert kept == {"a", "d", "e", "f"}


def test_packing_skips_and_goes_on(spark):
    units = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 40), (1, 4, 1)], "q int, u long, c int")
    rows = {r.u: (r.kept, r.used) for r in context.greedy_pack(units, ["q"], "u", "c", 100, ["u"]).collect()}
    assert rows == {1: (True, 60), 2: (False, 60), 3: (True, 100), 4: (False, 100)}
    assert {r.u: r.batch for r in context.next_fit(units, ["q"], "u", "c", 100, ["u"]).collect()} == {1: 0, 2: 1, 3: 1, 4: 1}
    paid = spark.createDataFrame([(1, 101)], "q int, cost int")
    assert context.pack_context(paid, units, ["q"], "u", "c", 100, ["u"]).where("kept").count() == 0


def test_select_context(spark):
    rows = [(1, i + 1, a, "h", b, "rare words") for i, (a, b) in enumerate([("x", "one"), ("x", "two"), ("y", "three"), ("z", "rare"), ("x", "four"), ("w", "five")])]
    ranked = spark.createDataFrame(rows, "q int, rank int, article string, heading string, body string, question string")
    out = context.select_context(ranked, ["q"], "article", "question", 4).orderBy("place").collect()
    assert [r.body for r in out] == ["one", "three", "rare", "two"]
    flagged = context.anchors(ranked, ["q"], "article", 6).where("anchor").orderBy("rank").collect()
    assert [r.article for r in flagged] == ["x", "y", "z", "w"]


def test_history(spark):
    turns = ["system", "user", "assistant", "user", "user", "assistant", "user", "assistant"]
    chat = spark.createDataFrame([(1, i, r, "words here") for i, r in enumerate(turns)], "conv_id long, turn long, role string, text string")
    rows = {r.turn: (r.unit, r.current) for r in context.history_units(chat).collect()}
    assert rows == {0: (0, False), 1: (1, False), 2: (1, False), 3: (3, False), 4: (4, False), 5: (4, False), 6: (None, True), 7: (None, False)}
    kept = {r.unit for r in context.pack_history(chat, 40).where("kept").collect()}
    assert kept and max(kept) == 4


def test_maintenance(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "path string, hash string")
    old = spark.createDataFrame([("a", "1"), ("b", ""), ("c", "0")], "path string, hash string")
    assert {r.path: r.status for r in maintenance.changed_sources(now, old).collect()} == {"a": "same", "b": "baseline", "c": "changed", "d": "new"}
    folders = spark.createDataFrame([("a/b",), ("a",), ("a/b/c/",), ("ab",)], "path string")
    assert {r.path for r in maintenance.consolidate_prefixes(folders).collect()} == {"a", "ab"}
    sources = spark.createDataFrame([("s", 10)], "k string, lines int")
    ranges = spark.createDataFrame([("s", 2, 4), ("s", 3, 3), ("s", 8, 9)], "k string, start int, end int")
    assert {(r.gap_start, r.gap_end) for r in maintenance.line_gaps(sources, ranges, "k").collect()} == {(1, 1), (5, 7), (10, 10)}
    stored = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    kept, gone = maintenance.remove_with_authority(stored, stored.where("id = 'a'"), ["id"])
    back, clash = maintenance.restore(kept, gone, ["id"])
    assert kept.count() == 1 and back.count() == 2 and clash.count() == 0


def test_overlap_assignment_matches_loops(spark):
    rng = random.Random(4)
    items = [(1, i, s := rng.randrange(300), s + rng.randrange(100)) for i in range(40)]
    bundles = [(1, b, b % 2 == 0, b, s := rng.randrange(300), s + rng.randrange(150)) for b in range(12)]
    got = maintenance.overlap_assignment(spark.createDataFrame(items, "k int, item int, start int, end int"), spark.createDataFrame(bundles, "k int, bundle int, primary boolean, pos int, start int, end int"), "k", "item", "bundle")
    want = {}
    for _, i, s, e in items:
        best = max(((min(e, y) - max(s, x) + 1, p, -pos, b) for _, b, p, pos, x, y in bundles if s <= y and x <= e), default=None)
        if best:
            want[i] = (best[3], best[0])
    assert {r.item: (r.bundle, r.overlap) for r in got.collect()} == want


def test_all_scores_come_in_bounded_tiles(monkeypatch):
    """Where every score is kept, no batch has more than TILE rows against SLICE queries."""
    import types

    import pyarrow as pa

    for name, value in (("TILE", 7), ("SLICE", 3)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(1)
    q, x = vectors.unit(rng.standard_normal((8, 4))), rng.standard_normal((50, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(x.tolist()), pa.array([0] * 50)], ["id", "vector", "group"])
    out = list(vectors._best(types.SimpleNamespace(value=(np.arange(8), q)), None, False)([batch]))
    assert max(b.num_rows for b in out) <= 21
    got = {(r["query"], r["id"]): r["cosine"] for b in out for r in b.to_pylist()}
    want = np.round(vectors.unit(x) @ q.T, 6)
    assert len(got) == 400 and all(abs(got[k, i] - want[i, k]) < 1e-9 for k in range(8) for i in range(50))
