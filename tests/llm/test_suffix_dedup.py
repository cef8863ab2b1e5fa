import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from lorekeep.llm import hashing, suffix_dedup
from lorekeep.llm.queries import op3_suffix_dedup
from tests.llm.common import SF, documents


def brute(texts, length=400):
    """(n_bytes, n_removed, n_spans, sha) of each text, by counting every window."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(hashlib.blake2b(d[i : i + length], digest_size=12).digest() for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - length + 1):
            if seen[hashlib.blake2b(d[i : i + length], digest_size=12).digest()] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        hit = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        out.append((len(d), int(hit.sum()), spans, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~hit])).hexdigest()))
    return out


def rows(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, sum(s.hi - s.lo for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect())


def expected(keys, texts, length=400):
    return sorted((k is None, k or 0, *b) for k, b in zip(keys, brute(texts, length)))


def test_deep_shallow_order():
    rng = random.Random(3)
    for alphabet, n in ((b"ab", 60), (b"abcdefgh", 40), (b"a", 30)):
        strings = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)]
        strings += [b"x" * 30 + s for s in strings]
        for shallow in (0, 3, 12):
            order, prefix = suffix_dedup.deep_shallow(strings, shallow)
            assert [strings[i] for i in order] == sorted(strings)
            for k in range(1, len(order)):
                x, y = strings[order[k - 1]], strings[order[k]]
                assert prefix[k] == next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))


def made_up(rng):
    words = [f"{rng.randrange(10**6):x}é" for _ in range(4000)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, short, base = some(120), some(45), some(600)
    texts = [None, "", "short", base, base, base[:1500] + "!" + base[1502:], some(300) + passage + some(20), passage + some(10), some(5) + passage, passage * 3, "ab" * 900, "ab" * 900 + some(50)]
    texts += [some(50) + short + some(50) for _ in range(8)]
    texts += [some(60) + passage[: rng.randrange(300, len(passage))] + some(30) for _ in range(20)]
    texts += [some(60) + passage[rng.randrange(200) :] + some(30) for _ in range(20)]
    return texts


def test_against_every_window(spark, monkeypatch):
    texts = made_up(random.Random(11))
    keys = [*range(len(texts) - 1), None]
    out = suffix_dedup.remove_repeats(documents(spark, list(zip(keys, texts)), extra=True))
    assert rows(out) == expected(keys, texts)
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0


@pytest.mark.parametrize("most", [1, 5])
def test_large_groups_are_split(spark, monkeypatch, most):
    sizes, settle = [], suffix_dedup._settled

    def watched(members, length, gram, limit):
        sizes.append(members.groupBy("h").count().agg({"count": "max"}).first()[0])
        return settle(members, length, gram, most)

    monkeypatch.setattr(suffix_dedup, "_settled", watched)
    texts = made_up(random.Random(12))
    assert rows(suffix_dedup.remove_repeats(documents(spark, list(enumerate(texts))))) == expected(range(len(texts)), texts)
    assert sizes[0] > most  # else nothing was split


def test_a_text_gives_its_contexts_once(spark, monkeypatch):
    members, settle = [], suffix_dedup._settled
    monkeypatch.setattr(suffix_dedup, "_settled", lambda m, *a: members.append(m.count()) or settle(m, *a))
    rng = random.Random(13)
    some = lambda n: " ".join(f"{rng.randrange(10**6):x}" for _ in range(n))
    copy, passage = some(500), some(40)
    one = [copy] * 30
    assert rows(suffix_dedup.remove_repeats(documents(spark, list(enumerate(one))))) == expected(range(30), one)
    assert members == [0]  # equal contexts cover themselves
    two = [some(60) + passage + some(60)] * 30 + [some(60) + passage + some(60)]
    assert rows(suffix_dedup.remove_repeats(documents(spark, list(enumerate(two))))) == expected(range(31), two)
    assert 2 <= members[1] <= 12


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(hashing, "BLOCK", 2000)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 2000)
    import pyarrow as pa

    rng = random.Random(2)
    text = "".join(rng.choice("abcd ") for _ in range(9000))
    found = set()
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8], pa.int64()), pa.array([text, text], pa.string())], ["th", "text"])
    for b in suffix_dedup._anchors(400, 200)([batch]):
        for r in b.to_pylist():
            found |= {(r["th"], s) for s in range(r["a"], r["b"] + 1)}
            assert r["a"] <= r["p"] <= r["a"] + 200 or r["b"] <= r["p"] <= r["b"] + 200
    assert found == {(k, s) for k in (7, 8) for s in range(9000 - 399)}


def test_texts_that_fill_a_block(monkeypatch):
    monkeypatch.setattr(hashing, "BLOCK", 2000)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 2000)
    import pyarrow as pa

    rng = random.Random(4)
    sizes = [0, 700, 0, 500, 800, 2000, 0, 900, 900, 200]  # blocks of 2,000, 2,000 and again 2,000 bytes
    texts = ["".join(rng.choice("abcd ") for _ in range(n)) for n in sizes]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes)), pa.int64()), pa.array(texts, pa.string())], ["th", "text"])
    found = [(r["th"], s) for b in suffix_dedup._anchors(400, 200)([batch]) for r in b.to_pylist() for s in range(r["a"], r["b"] + 1)]
    assert sorted(found) == [(k, s) for k, n in enumerate(sizes) for s in range(n - 399)]


def test_repeats_in_texts_that_fill_a_block(spark):
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = some(900)
    texts = [some(9100) + passage + some(20_000) for _ in range(30)]
    texts.append(passage + some(hashing.BLOCK - sum(map(len, texts)) - 900))
    assert sum(map(len, texts)) == hashing.BLOCK
    docs = documents(spark, list(enumerate(texts))).coalesce(1)
    assert rows(suffix_dedup.remove_repeats(docs)) == expected(range(31), texts)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_query_against_every_window(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op3_suffix_dedup(spark, SF).collect())
    assert got == expected([r.doc_id for r in docs], [r.text for r in docs])
