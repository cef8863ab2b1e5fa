import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from lorekeep.llm import privacy
from tests.llm.common import SF, documents
from tests.llm.test_near_dedup import brute
from tests.llm.test_packing import check


def brute_kept(texts, good):
    """What the first four stages leave, by plain loops; ``good``: docs that the rules keep."""
    first = {}
    for i in sorted(good):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i] or ""), i)
    once = {i: texts[i] for i in first.values()}
    near = brute(once, 5, 80)
    return {i: privacy.rewrite(t)[0] for i, t in once.items() if near[i][2]}


def rejected_by_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(tri)
    hit = {j for i, t in enumerate(tri) if c[t] > 1 for j in (i, i + 1, i + 2)}
    return len(w) < 50 or 100 * len(hit) > 50 * len(w)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    first = corpus_pipeline.keep_quality(spark, docs, SF)
    assert first.columns == docs.columns
    good = {r.doc_id for r in first.collect()}
    assert not any(rejected_by_base(texts[i]) for i in good)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(labels.get(i, 1) == 1 for i in good)
    assert all(i in good or rejected_by_base(texts[i]) for i, q in labels.items() if q == 1)
    check(corpus_pipeline.run(spark, SF).collect(), brute_kept(texts, good))


def test_stages_on_edge_rows(spark):
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, long), (None, long + " more"), (5, "x " * 400)]
    clashing = documents(spark, rows, extra=True).selectExpr("*", "1 AS __rules", "2 AS __entities", "3 AS `___rules`", "4 AS `odd.name`")
    for table in (documents(spark, rows), documents(spark, []), clashing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == table.columns
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()
    stay = clashing
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        stay = stage(spark, stay, SF)
    assert {(r["__rules"], r["__entities"], r["key"], r["odd.name"]) for r in stay.collect()} == {(1, 2, "x", 4)}
    kept = corpus_pipeline.drop_exact_copies(spark, documents(spark, rows), SF).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 3), (False, 5), (True, 0)]
