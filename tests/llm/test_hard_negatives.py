import math
import os
import random

import pytest
from pyspark.sql import functions as F

from lorekeep.llm import hard_negatives
from lorekeep.llm.queries import op11_hard_negatives
from tests.llm.common import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, positives=5, negatives=10, low=30, high=90):
    """(anchor, positive, rank, negative, positive score, negative score), every pair scored.
    ``rows``: (vec_id, vector, label); anchors are ids divisible by 100."""
    good = [(k, [math.floor(256 * x) for x in v], y) for k, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    falling = lambda p: (-p[0], p[1] is None, p[1] or 0)
    out = []
    for i, (k, v, y) in enumerate(good):
        if k is None or k % 100:
            continue
        scored = [(dot(v, w), j, z) for n, (j, w, z) in enumerate(good) if n != i]
        for ps, p, _ in sorted((s for s in scored if s[2] == y), key=falling)[:positives]:
            fit = sorted((s for s in scored if s[2] != y and low * ps <= 100 * s[0] <= high * ps), key=falling)[:negatives]
            out += [(k, p, r + 1, n, ps, ns) for r, (ns, n, _) in enumerate(fit)]
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def run(spark, rows, parts=3, **options):
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS uid", "'x' AS key", "'x' AS a", "1 AS chunk", "1 AS score").repartition(parts)
    return ordered(hard_negatives.hard_negatives(table, F.col("key") % 100 == 0, **options).collect())


def made(rng, n, dims=10, labels=4, step=1):
    """Rows whose components are multiples of 1/4, so that scores tie often."""
    return [(i * step, [rng.randrange(-2, 3) / 4 for _ in range(dims)], min(int(rng.expovariate(0.7)), labels)) for i in range(n)]


@pytest.mark.parametrize("anchors,rows,chunk,cell", [(128, 2048, 32, 4), (3, 7, 3, 1), (1, 50, 4, 2)])
def test_against_brute_force(spark, monkeypatch, anchors, rows, chunk, cell):
    for name, value in (("ANCHORS", anchors), ("ROWS", rows), ("CELL", cell)):
        monkeypatch.setattr(hard_negatives, name, value)
    table = made(random.Random(anchors), 120, step=25)
    assert run(spark, table, chunk=chunk) == ordered(brute_force(table))


def test_edge_rows(spark):
    rng = random.Random(2)
    table = made(rng, 40, step=50)
    table += [(100, None, 1), (200, [None] * 10, 1), (300, [float("nan")] * 10, 1), (400, [float("inf")] * 10, 1), (500, [0.5] * 10, None), (None, [0.5] * 10, 1), (None, [0.5] * 10, 1)]
    table += [(600, [0.5] * 10, 1), (600, [0.5] * 10, 1), (601, [0.5] * 10, 1), (700, [], 2), (701, [], 2), (702, [0.25] * 3, 3), (800, [0.0] * 10, 1), (900, [-0.5] * 10, 9)]
    got = run(spark, table)
    assert got == ordered(brute_force(table)) and any(r[0] == 600 and r[1] == 600 for r in got)
    assert run(spark, []) == [] and run(spark, [(1, [1.0], 1)]) == []
    assert run(spark, [(100, [1.0], 1)]) == []  # no other row
    assert run(spark, [(100, [1.0], 1), (2, [1.0], 1), (3, [0.75], 2), (4, [0.5], 2)]) == [(100, 2, 1, 3, 256 * 256, 256 * 192), (100, 2, 2, 4, 256 * 256, 256 * 128)]


def test_products_beyond_doubles_are_exact(spark):
    big = 2.0**19 + 0.5
    table = [(100, [big, 1 / 256], 1), (1, [big, 2 / 256], 1), (2, [big / 2, 1 / 256], 2), (3, [big / 2, 2 / 256], 2)]
    assert run(spark, table) == ordered(brute_force(table))


def test_parameters(spark):
    table = made(random.Random(7), 80, step=20)
    assert run(spark, table, positives=2, negatives=3, low=10, high=95) == ordered(brute_force(table, 2, 3, 10, 95))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert ordered(op11_hard_negatives(spark, SF).collect()) == ordered(brute_force(rows))
