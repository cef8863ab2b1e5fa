import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.operators import demotion, ranking, vectors


def _rows(flagged: float, near: bool, copies: bool, text: bool):
    """Vectors of which a share is flagged, with ``near`` the ones that are closest to all queries."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 4)).astype(np.float32) + 1
    x[::10] = 1 + x[::10] / 20
    if copies:
        x[200:] = x[:200]
    closeness = vectors.unit(x.astype(float)) @ np.full(4, 0.5)
    flag = closeness > np.quantile(closeness, 1 - flagged) if near else rng.random(400) < flagged
    name = (lambda i: f"v{i:04}") if text else int
    rows = [(name(i), v.tolist(), None if i == 7 else bool(f), i % 10 == 0) for i, (v, f) in enumerate(zip(x, flag))]
    rows += [(name(i), x[j].tolist(), bool(flag[j]), True) for i, j in ((0, 11), (30, 30))]  # ids of several vectors
    return rows + [(name(900), [1.0, 2.0], False, True), (name(901), None, True, True), (name(902), [0.0] * 4, True, False)], "string" if text else "long"


@pytest.mark.parametrize("flagged, near, copies, text, counts", [(0.1, False, False, False, False), (0.6, True, False, False, True), (0.6, True, True, True, True), (1.0, True, False, False, True), (0.0, False, True, False, False)])
def test_against_the_whole_list(spark, monkeypatch, flagged, near, copies, text, counts):
    """The best of either kind, placed by counts where these are needed, give what demotion of all scores gives."""
    for name, value in (("QUERIES", 17), ("PENDING", 50)):
        monkeypatch.setattr(demotion, name, value)
    for name, value in (("SLICE", 5), ("TILE", 30)):
        monkeypatch.setattr(vectors, name, value)
    passes, plain = [], demotion._before
    monkeypatch.setattr(demotion, "_before", lambda *a: passes.append(1) or plain(*a))
    rows, kind = _rows(flagged, near, copies, text)
    df = spark.createDataFrame(rows, f"id {kind}, v array<float>, flag boolean, asked boolean").repartition(5)
    q = df.where("asked")
    every = vectors.similarities(q, df.withColumn("flag", F.coalesce("flag", F.lit(False))), "id", "v", "flag")
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("cosine").desc(), "id", "group"))).localCheckpoint()
    for limit, factor in ((6, 0.15), (6, 0.0), (0, 0.15)) if text else ((6, 0.15),):
        want = ranking.demote(ranked, ["query"], F.col("group"), limit, factor)
        got = demotion.top_demoted(q, df, "id", "v", F.col("flag"), limit, factor)
        assert sorted((r.query, r["rank"], r.id) for r in got.collect()) == sorted((r.query, r["rank"], r.id) for r in want.collect())
    assert bool(passes) == counts
    assert demotion.top_demoted(q.where("false"), df, "id", "v", F.col("flag"), 6).count() == 0


def test_a_task_hands_on_the_best_rows_only():
    """However many batches a task reads and however many rows are alike."""
    rng = np.random.default_rng(1)
    q, x = vectors.unit(rng.standard_normal((9, 4))), np.repeat(rng.standard_normal((300, 4)), 20, axis=0)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 500)), pa.array(x[i : i + 500].tolist()), pa.array([j % 3 == 0 for j in range(i, i + 500)])], ["id", "vector", "flag"]) for i in range(0, 6000, 500)]
    out = [r for b in demotion._kept(types.SimpleNamespace(value=(np.arange(9), q)), 5)(iter(batches)) for r in b.to_pylist()]
    scores = np.round(vectors.unit(x) @ q.T, 6)
    want = [(k, i) for k in range(9) for f in (0, 1) for i in sorted((i for i in range(6000) if (i % 3 == 0) == f), key=lambda i: (-scores[i, k], i))[:5]]
    assert sorted((r["query"], r["id"]) for r in out) == sorted(want)


def test_the_query_ranks_no_whole_list(spark):
    """Its shuffles hold the best rows of a task, not every score."""
    from lorekeep.plans.catalogue import QUERIES

    plan = QUERIES["demoted_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "best-of-either-kind" in plan
