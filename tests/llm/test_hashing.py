import re

import numpy as np
import pyarrow as pa

from lorekeep.llm import hashing


def naive(text, lower=False):
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) if lower else data)
    return words


def test_words_match_a_naive_split(monkeypatch):
    texts = ["", None, " ", "a", "a b", " a\x0b\x0cb\r\nc ", "Été ÀB b", "x" * 50, "one two three " * 20, "\x1c\x85 z", "a"]
    for block in (1 << 20, 16):
        monkeypatch.setattr(hashing, "BLOCK", block)
        for lower in (False, True):
            seen, rows = {}, 0
            for first, hashes, counts in hashing.word_hashes(pa.array(texts, pa.string()), lower):
                at = 0
                for k, n in enumerate(counts):
                    words = naive(texts[first + k], lower)
                    assert len(words) == n
                    for w, h in zip(words, hashes[at : at + n].tolist()):
                        assert seen.setdefault(w, h) == h
                    at += n
                    rows += 1
            assert rows == len(texts)
            assert len(set(seen.values())) == len(seen)


def test_shingles():
    w = np.arange(1, 9, dtype=np.uint64)
    assert len(hashing.shingle_hashes(w, 3)) == 6
    assert len(hashing.shingle_hashes(w[:2], 3)) == 1
    assert len(hashing.shingle_hashes(w[:0], 3)) == 0
    assert len(set(hashing.shingle_hashes(w, 3).tolist())) == 6
