import os
import random
import zlib

import numpy as np
import pytest

from lorekeep.llm import quality_classifier, toxicity
from lorekeep.llm.queries import op4_quality_classifier, op10_toxicity
from tests.llm.common import documents

BIG = "/root/testdata/sf0.01"


def test_prior_estimate():
    rng = np.random.default_rng(0)
    for prior in (0.3, 0.8):
        p = rng.normal(2, 1, (4000, 3))
        u = np.where(rng.random((4000, 1)) < prior, rng.normal(2, 1, (4000, 3)), rng.normal(-2, 1, (4000, 3)))
        assert abs(quality_classifier.estimate_prior(p, u) - prior) < 0.08


def test_risk_descent_separates():
    rng = np.random.default_rng(1)
    p, n = rng.normal(1.5, 1, (800, 2)), rng.normal(-1.5, 1, (800, 2))
    w = quality_classifier._risk_descent(p[:400], np.vstack([p[400:], n[:400]]), 0.5)
    assert ((n[400:] @ w[:-1] + w[-1]) < 0).mean() > 0.95 and ((p @ w[:-1] + w[-1]) > 0).mean() > 0.95


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score", [quality_classifier.quality_scores, toxicity.toxicity])
def test_edge_rows(spark, score):
    rows = [(None, "text"), (1, None), (2, ""), (3, "a fine text " * 4000), (3, "a fine text " * 4000), (4, "plain words here")]
    for labels in ([], [(3, 1, 1)], [(1, 1, 0), (3, 0, 1), (4, 1, None), (None, 1, 1), (3, 1, 1)]):
        out = score(documents(spark, rows, extra=True), labels_of(spark, labels)).collect()
        assert len(out) == len(rows)
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
        assert len({r.score for r in out if r.doc_id == 3}) == 1
    assert score(documents(spark, []), labels_of(spark, [])).count() == 0


@pytest.mark.skipif(not os.path.isdir(BIG), reason="no test data")
def test_every_document_labelled(spark):
    """Nothing is left without a label, and the scores still tell junk from prose."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    found = {r.doc_id: r.score for r in op4_quality_classifier(spark, BIG).collect()}
    labels = labels_of(spark, [(i, known.get(i, int(x >= 0.3)), 0) for i, x in found.items()])
    rows = [r for r in quality_classifier.quality_scores(docs, labels).collect() if r.held_out and r.doc_id in known]
    good, bad = ([r.score for r in rows if known[r.doc_id] == q] for q in (1, 0))
    assert np.mean([x > y for x in good for y in bad]) >= 0.9
    assert {r.predicted for r in rows} == {0, 1}


def test_deobfuscation():
    rng = random.Random(0)
    words = ["stupid", "trash", "clown", "window", "garden", "letter", "people", "almost", "total", "loose"]
    cells = np.full((toxicity.LETTERS, toxicity.LETTERS), 0.01)
    for _ in range(20_000):
        w = f" {rng.choice(words)} "
        for a, b in zip(w, w[1:]):
            cells[ord(a), ord(b)] += 1
    r = toxicity.Restorer(np.log(cells / cells.sum(1, keepdims=True)))
    for seen, meant in (("tr4sh", "trash"), ("stuuuupid", "stupid"), ("cl0wn", "clown"), ("5tup1d", "stupid"), ("gaaarden", "garden")):
        assert meant in r.words(f"so {seen}, yes"), seen
    assert "stupid" in r.words("you s t u p i d thing") and "clown" in r.words("a c.l.o.w.n !")
    assert r.words("garden 2024 letter") == {"garden", "2024", "letter"}
    assert r.words(None) == set()


@pytest.mark.parametrize(
    ("seen", "meant"),
    [("idio7", "idiot"), ("idio7,", "idiot"), ("idio7.", "idiot"), ("idio7!", "idiot"), ('"1diot"', "idiot"), ("(idio7)", "idiot"), ("“1diot”", "idiot"), ("1 d 1 0 t", "idiot"), ("i d 1 o t", "idiot"), ("m 0 r 0 n", "moron"), ("t r @ s h", "trash"), ("$ c u m", "scum"), ('"m 0 r 0 n"', "moron"), ("a s s", "ass"), ("a $ $", "ass"), ("stuupid", "stupid"), ("5tuupid", "stupid")],
)
def test_obfuscations_at_the_gates(seen, meant):
    rng = random.Random(0)
    words = ["stupid", "trash", "clown", "idiot", "moron", "scum", "ass", "window", "garden", "letter", "people", "almost", "total", "loose"]
    cells = np.full((toxicity.LETTERS, toxicity.LETTERS), 0.01)
    for _ in range(20_000):
        w = f" {rng.choice(words)} "
        for a, b in zip(w, w[1:]):
            cells[ord(a), ord(b)] += 1
    r = toxicity.Restorer(np.log(cells / cells.sum(1, keepdims=True)))
    assert meant in r.words(f"so {seen} yes"), r.words(f"so {seen} yes")
    assert r.words("1 2 3 4 5 and a a a or 7 - 8 - 9") == {"1", "2", "3", "4", "5", "and", "a", "or", "7", "8", "9"}


@pytest.mark.skipif(not os.path.isdir(BIG), reason="no test data")
@pytest.mark.parametrize(("query", "label", "folds", "fold", "cut", "least"), [(op4_quality_classifier, "quality", 5, 0, 0.3, 0.95), (op10_toxicity, "toxic", 3, 1, 0.7, 0.93)])
def test_held_out_accuracy(spark, query, label, folds, fold, cut, least):
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    rows = query(spark, BIG).collect()
    assert len(rows) == spark.read.parquet(f"{BIG}/documents.parquet").count()
    right = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)
        assert r.predicted == int(r.score >= cut)
        if r.held_out and r.doc_id in truth:
            right.append(r.predicted == truth[r.doc_id])
    assert np.mean(right) >= least
