import hashlib
import random
import re
from collections import Counter

from lorekeep.llm import exact_dedup
from tests.llm.common import documents


def test_misra_gries_bounds():
    rng = random.Random(1)
    items = [b"hot"] * 400 + [b"warm"] * 150 + [str(rng.randrange(10**6)).encode() for _ in range(500)]
    rng.shuffle(items)
    low, true = exact_dedup.misra_gries(iter(items), 10), Counter(items)
    assert len(low) <= 10
    assert all(true[x] - len(items) / 11 <= low.get(x, 0) <= true[x] for x in true)


def test_groups(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "", "same  text\n", "same text ", f"own {i}", "b\x0bc", "b c"])) for i in range(300)]
    rows += [(5, "twice"), (5, "twice"), (None, "twice"), (None, "lonely"), (None, "lonely")]
    for k in (2, 1024):  # all groups frequent, or few
        docs = documents(spark, rows, extra=True)
        got = exact_dedup.exact_dedup(docs, k=k).collect()
        assert len(got) == len(rows)
        groups = {}
        for i, t in rows:
            groups.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest(), []).append(i)
        assert Counter(r.text_sha256 for r in got) == {s: len(g) for s, g in groups.items()}
        for r in got:
            g = groups[r.text_sha256]
            assert r.group_size == len(g)
            assert r.keep_id == min((i for i in g if i is not None), default=None)
        assert Counter(r.text_sha256 for r in got if r.kept) == dict.fromkeys(groups, 1)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
        stay = exact_dedup.keep_first(docs, k=k)
        assert stay.columns == docs.columns
        assert Counter(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest() for r in stay.collect()) == dict.fromkeys(groups, 1)


def test_frequent_digests_are_found(spark):
    docs = documents(spark, [(i, "hot" if i % 3 == 0 else f"own {i}") for i in range(600)])
    digests = docs.selectExpr("doc_id AS key", "unhex(sha2(text, 256)) AS digest", "monotonically_increasing_id() AS row")
    found = exact_dedup.frequent(digests, 8).collect()
    assert [(r.group_size, r.winner.key) for r in found if r.group_size > 1] == [(200, 0)] and len(found) <= 8


def test_empty_table(spark):
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0
