import random

from pyspark.sql import functions as F

from lorekeep import storage
from lorekeep.operators import graph
from lorekeep.plans import graph_queries


def brute(seeds, nodes, edges, depth):
    steps = {}
    for a, b in edges:
        if b in nodes:
            steps.setdefault(a, set()).add(b)
        steps.setdefault(b, set()).add(a)
    seen, frontier = {s: 0 for s in seeds}, set(seeds)
    for hop in range(1, depth + 1):
        frontier = {b for a in frontier for b in steps.get(a, ()) if b not in seen}
        seen |= {b: hop for b in frontier}
    return seen


def made(spark, n, seed):
    """A random graph with one hub, phantom targets and a far chain."""
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n + 20)) for _ in range(2 * n)] + [(0, i) for i in range(1, n, 2)] + [(n + 100 + i, n + 101 + i) for i in range(6)] + [(1, n + 100)]
    nodes = [*range(n), *range(n + 100, n + 107)]
    return nodes, edges, spark.createDataFrame([(i,) for i in nodes], "id long"), spark.createDataFrame(edges, "src long, dst long")


def test_searches_through_hubs(spark, monkeypatch):
    nodes, edges, known, links = made(spark, 60, 3)
    for hub, large in ((5, 0.2), (7, 0.0), (10_000, 9.0)):  # parts of a hub, always from the open side, never
        monkeypatch.setattr(graph, "LARGE", large)
        for seeds, depth in (([7], 4), ([0, 70, 999], 2), ([66], 8)):
            df = spark.createDataFrame([(s,) for s in seeds], "id long")
            got = {r.id: r.hop for r in graph.bfs(df, known, links, depth, hub=hub).collect()}
            assert got == brute(seeds, set(nodes), edges, depth), (hub, large, seeds)
    pairs = [("x", 7), ("y", 0), ("y", 50)]
    got = {(r.g, r.id): r.hop for r in graph.bfs(spark.createDataFrame(pairs, "g string, id long"), known, links, 3, ["g"], hub=5).collect()}
    assert got == {(g, i): h for g in ("x", "y") for i, h in brute([i for k, i in pairs if k == g], set(nodes), edges, 3).items()}


def test_no_key_holds_a_hub(spark):
    """A hub of 100,000 links lies in parts of about 10,000, and so does its side of the join."""
    hub = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    steps = hub.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(hub.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    dealt, hubs = graph.salted(steps, graph.HUB)
    assert [tuple(r) for r in hubs.collect()] == [(0, 10)]
    assert dealt.groupBy("a", "part").count().agg(F.max("count")).first()[0] < 1.2 * graph.HUB and dealt.count() == 200_000
    found = graph.bfs(spark.createDataFrame([(5,)], "id long"), spark.range(100_001), hub, 2)
    assert {(r.hop, r.n) for r in found.groupBy("hop").agg(F.count("*").alias("n")).collect()} == {(0, 1), (1, 1), (2, 99_999)}


def test_ranked_without_a_group(spark):
    expanded = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1), ("d", 2)], "id string, hop int")
    scores = spark.createDataFrame([("b", 0.5), ("c", 0.5), ("d", 0.9)], "id string, score double")
    got = graph.bfs_ranked(expanded, scores, [], 2)
    assert {tuple(r) for r in got.collect()} == {("a", 0), ("d", 2), ("b", 1)}
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString() or "TakeOrdered" in got._jdf.queryExecution().executedPlan().toString()


def test_rows_are_dealt_by_their_number(spark, monkeypatch, tmp_path):
    """Narrow rows compress to little, so tasks are cut by rows and not by bytes; the search is the same."""
    monkeypatch.setattr(storage, "TASK_ROWS", 500)
    spark.range(20_000).selectExpr("id % 4000 AS l_partkey", "id % 37 AS l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(4000).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    nodes, edges = graph_queries._parts(spark, str(tmp_path))
    sizes = [len(rows) for rows in edges.rdd.glom().collect()]
    assert len(sizes) == 40 and max(sizes) < 700 and sum(sizes) == 20_000
    known, links, known_df, links_df = made(spark, 60, 4)
    got = {r.id: r.hop for r in graph.bfs(spark.createDataFrame([(7,)], "id long"), known_df, links_df, 4, hub=5).collect()}
    assert got == brute([7], set(known), links, 4)
