import os
import random
import re

import numpy as np
import pytest

from lorekeep.llm import near_dedup
from lorekeep.llm.components import connected_components
from lorekeep.llm.queries import op7_near_dedup
from tests.llm.common import SF, documents

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def brute(texts, size=3, percent=85):
    """All pairs by inverted index, then union-find."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOW))
        k = min(size, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                n = len(a & b)
                if 100 * n >= percent * (len(a) + len(b) - n):
                    p, q = sorted((root(ids[x]), root(ids[y])))
                    parent[q] = p
    return {i: (len(sets[i]), root(i), root(i) == i) for i in texts}


def rows(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_small_cases(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(220)]
    texts = {1: None, 2: "", 3: " \n ", 4: "A b", 5: "a B", 6: "a b c", 7: "A  B c", 8: "one", 9: " ".join(base)}
    chain = list(base)
    for i in range(10, 40):  # a chain whose ends are not similar
        chain[rng.randrange(len(chain))] = f"x{i}"
        chain[rng.randrange(len(chain))] = f"y{i}"
        texts[i] = " ".join(chain)
    for i in range(40, 60):
        texts[i] = " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(1, 12)))
    texts[60] = texts[9] + " " + "tail " * 30
    out = near_dedup.near_duplicates(documents(spark, texts.items(), extra=True), 3, 85)
    assert rows(out) == brute(texts)
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0


def test_repeated_rows_and_null_keys(spark):
    out = near_dedup.near_duplicates(documents(spark, [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q r s t"), (None, None)]), 3, 85)
    found = sorted(map(str, out.collect()))
    assert len(found) == 5
    assert sum(r.kept for r in out.collect()) == 4  # both rows of 1, and two lone rows without a key


def test_structured_words_do_not_collide(spark):
    """A Thue-Morse word and its complement, which polynomial hashes cannot tell apart."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = {1: word, 2: other, 3: word[:128], 4: other[:128], 5: word}
    assert rows(near_dedup.near_duplicates(documents(spark, texts.items(), extra=True), 3, 85)) == brute(texts)


def test_bands_follow_the_threshold():
    assert [near_dedup.band_rows(x) for x in (0.8, 0.85)] == [6, 7]
    assert all((1 - x ** near_dedup.band_rows(x)) ** (256 // near_dedup.band_rows(x)) <= near_dedup.MISSED for x in (0.5, 0.7, 0.8, 0.9, 0.95))


def test_estimates_are_close():
    rng = np.random.default_rng(1)
    for n in (300, 3000):
        pool = np.unique(rng.integers(0, 2**63, 2 * n).astype(np.uint64))
        a, b = pool[: n + n // 8], pool[n // 8 : n + n // 4]
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        e = near_dedup.estimate(near_dedup.registers(np.sort(a))[None], near_dedup.registers(np.sort(b))[None], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(e - truth) < 0.12


def test_groups_are_settled_exactly(spark, monkeypatch):
    """Near copies of one text, near the threshold, also when dealt into blocks."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    texts = {}
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(2, 9)):
            w[rng.randrange(len(w))] = f"v{i}" if rng.random() < 0.7 else "same"
        texts[i] = " ".join(w)
    for block in (4_000_000, 3000):
        monkeypatch.setattr(near_dedup, "BLOCK_ELEMENTS", block)
        assert rows(near_dedup.near_duplicates(documents(spark, texts.items()), 3, 85)) == brute(texts)


def test_joining():
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 2, 300, 304, 500)]
    assert near_dedup.joining([1, 2, 3, 4, 5], [1, 2, 3, 4, 5], sets, [False] * 5, 85) == [(1, 2), (3, 4)]
    assert near_dedup.joining([1, 2, 3, 4, 5], [1, 1, 3, 4, 5], sets, [False, True, False, True, True], 85) == [(3, 4)]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in connected_components(links).collect()}
    assert all(found[i] == 0 for i in range(41)) and {found[i] for i in (100, 101, 103)} == {100}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows(op7_near_dedup(spark, SF)) == brute(texts)


def test_representatives_are_decided_by_row(spark):
    """Rows that share a key, or have none, are judged by their own texts."""
    rng = random.Random(3)
    text = [" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(6)]
    table = [
        (1, text[0]),
        (None, text[0] + " more"),  # a near copy of 1
        (None, text[1]),
        (None, text[1] + " more"),  # a near copy without a key either
        (None, text[2]),
        (2, text[3]),
        (2, text[0] + " other"),  # a near copy of 1 under a key with a clean row
        (3, text[4]),
        (3, text[4]),
        (4, text[5].upper()),
        (4, text[5]),
        (None, None),
        (5, ""),
        (5, text[5] + " more"),
    ]
    docs = documents(spark, table, extra=True)
    out = near_dedup.keep_representatives(docs, 5, 80)
    assert out.columns == docs.columns
    found = [(r.doc_id, r.text) for r in out.collect()]
    for row in [(1, text[0]), (None, text[2]), (2, text[3]), (3, text[4]), (None, None), (5, "")]:
        assert found.count(row) == 1, row
    one = [x for x in found if x in table[2:4]], [x for x in found if x in table[9:11]]
    assert [len(x) for x in one] == [1, 1]
    assert len(found) == 8


def colliding_words(n=4_000_000):
    """Words of 16 bytes whose unkeyed hash is that of the first one, by inverting its steps."""
    from lorekeep.llm import hashing

    rng = np.random.default_rng(1)
    plain = np.array([c for c in range(0x21, 0x7F) if not 0x41 <= c <= 0x5A], np.uint8)
    heads = rng.choice(plain, (n, 8))
    first = np.frombuffer(heads.tobytes(), "<u8")
    h = hashing.mixed(np.full(1, 17, np.uint64) * hashing._ODD)
    state = hashing.mixed((h ^ first) * hashing._ODD)
    tails = (state ^ state[0] ^ np.frombuffer(b"suffixes", "<u8")).astype("<u8").view(np.uint8).reshape(-1, 8)
    good = np.flatnonzero(np.isin(tails, plain).all(1))
    return [bytes(np.concatenate([heads[i], tails[i]])).decode() for i in good.tolist()]


def test_words_made_to_collide_stay_apart(spark):
    from lorekeep.llm import hashing

    words = ["mntyadvyuvlsptuk", "cabraael2hwf5j9q"]
    made = colliding_words()
    assert len(made) > 50
    data = np.frombuffer("".join(made).encode(), np.uint8)
    starts = np.arange(len(made)) * 16
    assert len(set(hashing.spans_hash(data, starts, starts + 16).tolist())) == 1  # so the key is what keeps them apart
    texts = dict(enumerate(words + made))
    assert rows(near_dedup.near_duplicates(documents(spark, texts.items()), 3, 85)) == {i: (1, i, True) for i in texts}


def test_a_key_of_the_session(spark):
    texts = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z")]
    spark.conf.set("spark.lorekeep.hash.key", "some key")
    try:
        assert rows(near_dedup.near_duplicates(documents(spark, texts), 3, 85)) == {1: (4, 1, True), 2: (4, 1, False), 3: (1, 3, True)}
    finally:
        spark.conf.unset("spark.lorekeep.hash.key")
