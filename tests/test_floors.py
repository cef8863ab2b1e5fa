from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from lorekeep.operators import floors


def table(spark, rows, parts=4):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], t, g) for i, v, t, g in rows], "id long, v array<double>, t int, g int").repartition(parts)


def made(rng, n, dims=5, equal=0):
    rows = [(i, rng.standard_normal(dims), int(rng.integers(1, 9)), int(rng.integers(4))) for i in range(n)]
    return [(i, rows[0][1] if i < equal else v, t, g) for i, v, t, g in rows]


EDGES = [(900, None, 1, 1), (901, [], 1, 1), (902, [float("nan")] * 5, 1, 1), (903, [1.0, 2.0], 1, 1), (904, [0.0] * 5, 3, None)]


def cosines(queries, rows):
    u = lambda vs: np.array([np.array(v) / max(np.linalg.norm(v), 1e-300) for v in vs])
    good = [r for r in rows if r[1] is not None and len(r[1]) == 5 and np.isfinite(r[1]).all()]
    return good, np.round(u([q[1] for q in queries]) @ u([r[1] for r in good]).T, 6)


@pytest.mark.parametrize("n,equal,rounds", [(400, 0, 1024), (400, 390, 1024), (90, 30, 2), (1, 0, 8)])
def test_against_all_scores(spark, monkeypatch, n, equal, rounds):
    monkeypatch.setattr(floors, "QUERIES", rounds)
    rng = np.random.default_rng(n + equal)
    rows, queries = made(rng, n, equal=equal) + EDGES, made(rng, 7)
    good, c = cosines(queries, rows)
    low, high = np.percentile(c, 5, axis=1), c.max(1)
    got = {r.query: r for r in floors.prune_counts(table(spark, queries), table(spark, rows), "id", "v").collect()}
    for i in range(7):
        bar = round(low[i] + 0.6 * (high[i] - low[i]), 6) if high[i] - low[i] >= 1e-6 else round(low[i], 6)
        kept = (c[i] >= bar).sum() if high[i] - low[i] >= 1e-6 else len(good)
        assert abs(got[i].bar - bar) < 2e-6 and (got[i].kept, got[i].n) == (kept, len(good))
    ratios = [0.0, 0.5, 0.9]
    swept = {r.ratio: r for r in floors.sweep_counts(table(spark, queries), table(spark, rows), "id", "v", "t", "g", "g", ratios).collect()}
    tokens, group = np.array([r[2] for r in good]), [r[3] for r in good]
    for ratio in ratios:
        keep = np.array([(c[i] >= low[i] + ratio * (high[i] - low[i])) | (ratio <= 0) | (high[i] - low[i] < 1e-6) for i in range(7)])
        gold = np.array([[g == q[3] for g in group] for q in queries])
        recalls = [1.0 if not g.any() else (g & k).sum() / g.sum() for g, k in zip(gold, keep)]
        cut = round(100 * (tokens * ~keep).sum() / (7 * tokens.sum()), 6)
        assert (swept[ratio].cut_percent, swept[ratio].failing) == (cut, sum(r < 1 for r in recalls)) and abs(swept[ratio].least_recall - min(recalls)) < 1e-6


def test_empty(spark):
    some, none = table(spark, made(np.random.default_rng(1), 5)), table(spark, [])
    assert floors.prune_counts(none, some, "id", "v").count() == 0
    assert floors.prune_counts(some, table(spark, EDGES[:4]), "id", "v").count() == 0


def test_few_scores_leave_a_task():
    """Summaries are bounded by bins, and the second pass hands on the bins of the percentile only."""
    rng = np.random.default_rng(2)
    n, x = 50_000, rng.standard_normal((3, 16))
    q = floors._Round(pa.table({"query": [0, 1, 2], "vector": list(x), "want": [0, 1, 2]}))
    batch = pa.RecordBatch.from_pydict({"vector": list(rng.standard_normal((n, 16)))})
    first = next(floors._summaries(SimpleNamespace(value=q))([batch]))
    assert first.num_rows <= 3 * floors.BINS and sum(first.column("n").to_pylist()) == 3 * n
    at = np.array([1500, 1500, 1500])
    assert next(floors._within(SimpleNamespace(value=(q, at, at + 1)))([batch])).num_rows < 3 * n / 500
