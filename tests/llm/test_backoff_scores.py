import math
import random
from collections import Counter

import numpy as np
import pytest

from lorekeep.llm import backoff_scores
from tests.llm.common import documents


def brute(texts):
    words = [(t or "").split() for t in texts]
    one = Counter(w for ws in words for w in ws)
    two = Counter((v, w) for ws in words for v, w in zip([None, *ws], ws))
    one[None] = sum(bool(ws) for ws in words)
    total = sum(map(len, words))
    out = []
    for ws in words:
        s, b = 0.0, 0
        for v, w in zip([None, *ws], ws):
            if two[v, w] >= 2:
                s += math.log(two[v, w] / one[v])
            else:
                s, b = s + math.log(0.4 * one[w] / total), b + 1
        out.append((len(ws), b, round(s / len(ws), 6) if ws else None))
    return out


@pytest.mark.parametrize("heavy", [0, 3, 40, 65536])
def test_against_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(backoff_scores, "FLUSH", 500)
    monkeypatch.setattr(backoff_scores, "CORE", 20)
    rng = random.Random(heavy)
    words = [f"w{min(rng.randrange(300), rng.randrange(300))}" for _ in range(400)]
    texts = [None, "", " \n", "a", "a"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(80))) for _ in range(60)]
    texts += texts[10:13] + ["the same long line of words " * 400]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    got = backoff_scores.backoff_scores(documents(spark, rows, extra=True), heavy=heavy).collect()
    order = lambda x: (x[0] is None, x[0] or 0, x[1], x[2], x[3] or 0)
    want = sorted([(k, *b) for (k, _), b in zip(rows, brute(texts))], key=order)
    got = sorted([tuple(r) for r in got], key=order)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and (g[3] is None) == (w[3] is None) and abs((g[3] or 0) - (w[3] or 0)) < 2e-6


@pytest.mark.parametrize("texts", [["a a a a a"] * 2, ["a a a a a b", "a a a c", "b a", None], ["a b " * 50, "a b " * 40 + "c", "a a a c"]])
def test_start_mark_is_never_light(spark, texts):
    """Few long texts that begin with the same heavy word."""
    for heavy in (1, 2):
        got = backoff_scores.backoff_scores(documents(spark, enumerate(texts)), heavy=heavy).collect()
        want = brute(texts)
        for r in got:
            n, b, s = want[r.doc_id]
            assert (r.n_words, r.n_backoff) == (n, b) and abs((r.score or 0) - (s or 0)) < 2e-6


def test_empty_table(spark):
    assert backoff_scores.backoff_scores(documents(spark, [])).count() == 0


def test_codes_and_core_pairs():
    table = backoff_scores.Heavy(np.array([-1, -50, -7, -90], np.int64))
    assert table.codes(np.array([-7, -8, -1, -90])).tolist() == [2, -8, 0, 3]
    inside, cells = table.cells(np.array([0, 1, -8]), np.array([3, 2, 1]))
    assert inside.tolist() == [True, True, False] and cells.tolist() == [3, 6]
