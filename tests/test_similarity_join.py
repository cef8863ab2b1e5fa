import numpy as np
import pytest

from lorekeep.operators import similarity_join as sj

SCHEMA = "id long, v array<float>, label int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], g) for i, v, g in rows], SCHEMA).repartition(parts)


def cosines(rows):
    good = [(i, np.array(v, np.float32).astype(float), g) for i, v, g in rows if v is not None and len(v) and np.isfinite(v).all()]
    x = np.array([v for _, v, _ in good])
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return [i for i, _, _ in good], [g for _, _, g in good], np.round(x @ x.T, 6)


def brute_links(rows, threshold):
    ids, _, c = cosines(rows)
    out = []
    for r, i in enumerate(ids):
        other = [ids[k] for k in range(len(ids)) if k != r and c[r, k] >= threshold]
        out.append((i, len(other), min([i, *other])))
    return sorted(out)


def clustered(rng, n, dims=12, centres=6, noise=0.15, hot=0):
    """Vectors around centres; the first ``hot`` of them are one and the same."""
    c = rng.standard_normal((centres, dims))
    rows = [(i, c[rng.integers(centres)] + noise * rng.standard_normal(dims), int(rng.integers(7))) for i in range(n)]
    return [(i, rows[0][1] if i < hot else v, g) for i, v, g in rows]


def result(df):
    return sorted((r.id, r.links, r.least) for r in df.collect())


EDGES = [(900, None, 1), (901, [], 1), (902, [float("nan")] * 12, 1), (903, [float("inf")] * 12, 1), (904, [0.0] * 12, 1), (905, [1.0] * 12, None), (905, [1.0] * 12, 2), (906, [2.0] * 12, 3)]


@pytest.mark.parametrize("threshold,rows", [(0.9, 7), (0.5, 1024), (-1.0, 16)])
def test_exact_links(spark, threshold, rows):
    data = clustered(np.random.default_rng(rows), 90, hot=30) + EDGES
    assert result(sj.similarity_links(table(spark, data), "id", "v", threshold, rows=rows)) == brute_links(data, threshold)


def test_far_blocks_do_not_meet(spark):
    data = clustered(np.random.default_rng(3), 400, centres=8, noise=0.03)
    blocks = sj.exact_blocks(table(spark, data, 1), "id", "v", rows=10)
    n = blocks.count()
    assert sj.exact_pairs(blocks, 0.95).count() < n * (n + 1) / 2 / 4
    assert sj.exact_pairs(blocks, -1.0).count() == n * (n + 1) / 2


def test_a_block_is_sent_a_bounded_number_of_times(spark, monkeypatch):
    """The grid has no more groups for more blocks; every two blocks still meet once."""
    monkeypatch.setattr(sj, "SIDE", 3)
    data = clustered(np.random.default_rng(4), 400)
    for rows in (20, 5):
        blocks = sj.exact_blocks(table(spark, data, 1), "id", "v", rows=rows)
        n, pairs = blocks.count(), sj.exact_pairs(blocks, -1.0)
        met = {tuple(sorted((r.x, r.y))) for r in pairs.selectExpr("a.block x", "b.block y").collect()}
        assert len(met) == n * (n + 1) / 2 == pairs.count()
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RepartitionByExpression [row") == 2 and ", 12" in plan
    assert result(sj.similarity_links(table(spark, data), "id", "v", 0.9, rows=5)) == brute_links(data, 0.9)


def test_recall_at_several_thresholds(spark):
    data = clustered(np.random.default_rng(6), 150) + EDGES
    got = {r.threshold: r for r in sj.measured_recalls(table(spark, data), "id", "v", [0.5, 0.9, 1.5], rows=16).collect()}
    assert {t: r.links for t, r in got.items()} == {t: sum(x[1] for x in brute_links(data, t)) for t in (0.5, 0.9, 1.5)}
    assert all(r.recall >= 0.9 for r in got.values())


def test_similar_groups(spark):
    data = clustered(np.random.default_rng(5), 80, noise=0.5) + EDGES
    ids, groups, c = cosines(data)
    best = {}
    for i in range(len(ids)):
        for k in range(len(ids)):
            if groups[i] is not None and groups[k] is not None and groups[i] < groups[k]:
                key = groups[i], groups[k]
                best[key] = max(best.get(key, -2.0), c[i, k])
    got = sj.similar_groups(table(spark, data), "id", "v", "label", 0.8, rows=9).collect()
    assert sorted((r.a, r.b, r.score) for r in got) == sorted((a, b, s) for (a, b), s in best.items() if s >= 0.8)


def test_projections_find_what_they_promise(spark):
    data = clustered(np.random.default_rng(9), 300, noise=0.25, hot=100) + EDGES
    got, want = result(sj.projected_links(table(spark, data), "id", "v", 0.8, rows=16)), brute_links(data, 0.8)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want)
    row = sj.measured_recall(table(spark, data), "id", "v", 0.8, rows=16).first()
    assert row.links == sum(w[1] for w in want) and row.found == sum(g[1] for g in got) and row.recall >= 0.9


def test_equal_vectors_are_never_missed(spark):
    data = [(i, [1.0, 2.0, 3.0], 0) for i in range(50)] + [(99, [-1.0, 0.0, 0.5], 0)]
    assert result(sj.projected_links(table(spark, data), "id", "v", 0.99, rows=8)) == brute_links(data, 0.99)


def test_choice_of_projections():
    for threshold in (0.3, 0.5, 0.9, 0.999, 1.0):
        bits, tables = sj.projections(threshold, 0.95)
        p = (1 - np.arccos(threshold) / np.pi) ** bits
        assert 1 - (1 - p) ** tables >= 0.95 and tables <= sj.MOST_TABLES


def test_empty(spark):
    for rows in ([], EDGES[:4]):
        assert sj.similarity_links(table(spark, rows), "id", "v", 0.5).count() == 0
        assert sj.projected_links(table(spark, rows), "id", "v", 0.5).count() == 0
        assert sj.measured_recall(table(spark, rows), "id", "v", 0.5).first().recall == 1.0
