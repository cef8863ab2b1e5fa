import hashlib
import random

from pyspark.sql import functions as F

from lorekeep.operators import export, intervals


def test_containment_and_distance(spark):
    rng = random.Random(7)
    parents = [(1, p, s := rng.randrange(400), s + rng.randrange(20, 160)) for p in range(1, 12)]
    children = [(1, c, s := rng.randrange(400), s + rng.randrange(30)) for c in range(100, 125) for _ in range(2)]
    a, b = spark.createDataFrame(parents, "k int, parent int, start int, end int"), spark.createDataFrame(children, "k int, child int, start int, end int")
    want = {(c, p) for c in range(100, 125) for p in range(1, 12) if all(any(q == p and s2 <= s1 and e1 <= e2 for _, q, s2, e2 in parents) for _, x, s1, e1 in children if x == c)}
    assert {(r.child, r.parent) for r in intervals.containing(a, b, "k").collect()} == want
    size = {p: e - s + 1 for _, p, s, e in parents}
    least = {c: min((size[p], p) for x, p in want if x == c)[1] for c, _ in want}
    assert {r.child: r.parent for r in intervals.smallest_containing(a, b, "k").collect()} == least
    gap = lambda c, p: min(max(0, s1 - e2 - 1, s2 - e1 - 1) for _, x, s1, e1 in children if x == c for _, q, s2, e2 in parents if q == p)
    for r in intervals.nearest(a, b, "k").collect():
        assert r.distance == min(gap(r.child, p) for p in range(1, 12)) == gap(r.child, r.parent)
        assert r.parent == min(p for p in range(1, 12) if gap(r.child, p) == r.distance)


def test_nearest_sweeps_a_group_once_each_way(spark):
    n = 3000
    a, b = spark.range(n).selectExpr("0 AS k", "id AS parent", "id * 10 AS start", "id * 10 + 2 AS end"), spark.range(n).selectExpr("0 AS k", "id AS child", "id * 10 + 5 AS start", "id * 10 + 5 AS end")
    found = intervals.nearest(a, b, "k")
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.child, r.parent, r.distance) for r in found.collect()} == {(i, i, 2) for i in range(n)}


def test_nearest_in_small_and_large_groups(spark, monkeypatch):
    """Small groups have one row a range in their shuffles, and large ones the same result; ranges may end before their start."""
    rng = random.Random(11)
    made = lambda n: [(rng.randrange(6), i % 40, s := rng.randrange(60), rng.choice([s - 2, s, s + 3, s + 20, s + 5, None])) for i in range(n)]
    ps, cs = made(90) + [(7, 1, 5, 6)], made(120) + [(8, 1, 5, 6), (None, 1, 5, 6), (7, 2, None, 3)]
    gap = lambda s, e, ps, pe: max([0] + [a - b - 1 for a, b in ((s, pe), (ps, e)) if a is not None and b is not None])
    want = {}
    for k, c, s, e in cs:
        found = [(gap(s, e, *p[2:]), p[1]) for p in ps if p[0] == k]
        if found:
            want[k, c] = min([want.get((k, c), (99, 99))] + found)
    a, b = spark.createDataFrame(ps, "k int, parent int, start long, end long"), spark.createDataFrame(cs, "k int, child int, start long, end long")
    for few in (64, 15, 0):
        monkeypatch.setattr(intervals, "FEW", few)
        found = intervals.nearest(a, b, "k")
        assert ("Generate" in found._jdf.queryExecution().executedPlan().toString()) == (few < 64)
        assert sorted((r.k, r.child, r.distance, r.parent) for r in found.collect()) == sorted((*k, *v) for k, v in want.items())


def test_cells_tile_a_range(spark):
    rng = random.Random(2)
    ranges = [(s, s + rng.randrange(1 << rng.randrange(1, 12))) for s in (rng.randrange(-500, 3000) for _ in range(200))] + [(0, 0), (7, 6), (-8, -1), (5, 10**9 + 5), (1, (1 << 40) - 1)]
    df = spark.createDataFrame(ranges, "s long, e long").select("s", "e", intervals.cells(F.col("s"), F.col("e"), 41).alias("c"))
    for r in df.collect():
        spans = sorted((c.cell << c.level, (c.cell + 1) << c.level) for c in r.c)
        assert len(spans) <= 2 * max(1, (r.e - r.s + 1).bit_length())
        if r.e < r.s:
            assert not spans
        else:
            assert spans[0][0] == r.s and spans[-1][1] == r.e + 1 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_overlaps_of_ranges_of_any_length(spark):
    rng = random.Random(3)
    made = lambda n: [(rng.randrange(3), i, s := rng.randrange(-300, 10**10), s + rng.choice([0, 3, 10**5, 10**9]) - rng.choice([0, 0, 1])) for i in range(n)]
    xs, ys = made(60) + [(0, 900, 5, 10**9), (1, 901, None, 4)], made(60) + [(0, 900, 10**9, 10**9 + 7), (0, 901, 10, 20), (1, 902, 10**9 + 1, 10**9)]
    x, y = spark.createDataFrame(xs, "k int, i int, s1 long, e1 long"), spark.createDataFrame(ys, "k int, j int, s2 long, e2 long")
    want = sorted((i, j) for k, i, a, b in xs for m, j, c, d in ys if k == m and a is not None and a <= b and c <= d and a <= d and c <= b)
    assert sorted((r.i, r.j) for r in intervals.overlapping(x, y, ["k"], "s1", "e1", "s2", "e2").collect()) == want
    points = spark.createDataFrame([(0, 7), (0, 10**9), (0, 10**9 + 1), (2, 7), (0, None)], "k int, p long")
    one = spark.createDataFrame([(0, 5, 10**9)], "k int, s long, e long")
    assert sorted(r.p for r in intervals.within(points, one, ["k"], "p", "s", "e").collect()) == [7, 10**9]


def test_export(spark):
    pages = spark.createDataFrame([("t/a.md", "---\nx: 1\n---\n# A\n[[b|Bee]] [[gone]]"), ("t/b.md", "no title"), ("u/c.md", None)], "path string, content string")
    descriptions = spark.createDataFrame([("t/a.md", "about a")], "path string, description string")
    done, index, dead = export.export_pages(pages, descriptions)
    assert {r.path: r.content for r in done.collect()}["t/a.md"] == "---\nx: 1\n---\n# A\n[Bee](t/b.md) gone"
    assert {(r.path, r.title, r.description) for r in index.collect()} == {("t/a.md", "A", "about a"), ("t/b.md", "b", None), ("u/c.md", "c", None)}
    assert [(r.path, r.target) for r in dead.collect()] == [("t/a.md", "gone")]


def test_domain_events(spark):
    domains = spark.createDataFrame([("d", "Old", ["x", "y"]), ("e", "E", ["z"])], "id string, name string, source_paths array<string>")
    events = spark.createDataFrame([(1, "update", "d", "New", None), (2, "remove_path", "d", None, "x"), (3, "add_path", "d", None, "w"), (4, "delete", "e", None, None), (5, "create", "f", "F", None), (6, "add_path", "f", None, "q")], "seq long, op string, id string, name string, path string")
    rows = {r.id: (r.name, r.source_paths) for r in export.apply_domain_events(domains, events).collect()}
    assert rows == {"d": ("New", ["w", "y"]), "f": ("F", ["q"])}


def test_errors_and_proofs(spark):
    texts = ["This prompt has 9,000 tokens, maximum context length is 8192 tokens", "Rate limit exceeded for input", "input is too long", "all well"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(export.context_error(F.col("t")).alias("e")).collect()
    assert [(r.e.overflow, r.e.prompt, r.e.most) for r in rows] == [(True, 9000, 8192), (False, None, None), (True, None, None), (False, None, None)]
    chunks = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, o int, d string")
    one = hashlib.sha256(b"|a").hexdigest()
    assert export.chain_roots(chunks, "k", "o", "d").first().root == hashlib.sha256(f"{one}|b".encode()).hexdigest()
    segments = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "x"), (2, 0, "y")], "k int, ordinal int, text string")
    expected = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 1)], "k int, ordinal int")
    whole, problems = export.reassemble(segments, expected, "k")
    assert {r.k: r.text for r in whole.collect()}[1] == "ab" and {(r.k, r.ordinal, r.problem) for r in problems.collect()} == {(2, 0, "duplicate"), (2, 1, "missing")}


def test_points_have_a_row_a_level_that_ranges_use(spark):
    """A range of n lines has no cell of more than n lines; cells are single numbers, told apart at any distance."""
    ranges = spark.createDataFrame([(0, 1, 8), (0, -(1 << 62) - 5, -(1 << 62) - 1)], "k int, s long, e long")
    assert intervals._levels(ranges, "s", "e") == 3
    points = spark.createDataFrame([(0, p) for p in (0, 1, 8, 9, (1 << 62) - 3, -(1 << 62) - 5, -(1 << 62))], "k int, p long")
    found = intervals.within(points, ranges, ["k"], "p", "s", "e")
    assert "level" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.p for r in found.collect()) == [-(1 << 62) - 5, 1, 8]
