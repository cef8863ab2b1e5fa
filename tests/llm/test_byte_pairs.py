import base64
import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from lorekeep.llm import byte_pairs
from lorekeep.llm.queries import op12_byte_pairs
from tests.llm.common import SF, documents

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(data):
    return hashlib.sha256(data).hexdigest()


def ids_of(encoder, texts):
    out = [[] for _ in texts]
    for row, ids in encoder.encode_column(pa.array(texts, pa.string())):
        out[row] += ids.tolist()
    return out


def some_texts(rng, n):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    kinds = ["ab  '\nstmdrevl1", "abcdefgh'  12é日😀　 \t.!?-", "the and ing 's", every]
    return ["".join(rng.choice(rng.choice(kinds)) if rng.random() < 0.2 else rng.choice(kinds[rng.randrange(3)]) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_as_the_library(library, monkeypatch):
    rng = random.Random(3)
    texts = ["", "a", " ", "  ", "it's 'tis ''s 's'll'LL'vE we've 're'd'm  'm\n's \t's\n\n  x", " 's", "'", "'r", "'re", "x'l", "<|endoftext|>"]
    texts += ["a" * 5000, "ab " * 3000, " " * 4000, "!?" * 700 + "x", "日本語テキスト😀 é ñ" * 50] + some_texts(rng, 3000)
    e = byte_pairs.BytePairEncoder(PATH)
    want = [library.encode_ordinary(t) for t in texts]
    assert ids_of(e, texts) == want
    for t, ids in zip(texts, want):
        assert e.decode(np.array(ids, np.int64)) == t.encode()
    for name, value in (("BLOCK", 40), ("CELLS", 64), ("WIDEST", 6)):  # long texts, small matrices, the heap
        with monkeypatch.context() as m:
            m.setattr(byte_pairs, name, value)
            assert ids_of(e, texts[:600]) == want[:600]


def test_every_boundary_of_the_pattern(library):
    import itertools

    texts = ["".join(t) for n in range(1, 6) for t in itertools.product("a'sl 1\n", repeat=n)]
    assert ids_of(byte_pairs.BytePairEncoder(PATH), texts) == [library.encode_ordinary(t) for t in texts]


def test_pairs_table():
    rng = random.Random(5)
    found = {(rng.randrange(300), rng.randrange(300)): i for i in range(5000)}
    table = byte_pairs.Pairs(found)
    a, b = (np.array(x, np.int32) for x in zip(*[(i, j) for i in range(-1, 300, 3) for j in range(-1, 300)]))
    assert table.look_up(a, b).tolist() == [found.get(k, byte_pairs.NONE) for k in zip(a.tolist(), b.tolist())]


def test_rows(spark, library):
    texts = {1: None, 2: "", 3: "some text\nof two lines", 4: "long text " * 80_000, 5: "some text\nof two lines", 6: "日😀"}
    docs = documents(spark, [*texts.items(), (None, "no key")], extra=True)
    got = {r.doc_id: r for r in byte_pairs.encode_digests(docs, PATH).collect()}
    assert len(got) == 7
    for key, t in [*texts.items(), (None, "no key")]:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        assert (got[key].n_tokens, got[key].ids_sha256, got[key].decoded_sha256) == (len(ids), sha(ids.tobytes()), sha((t or "").encode()))
    encoded = byte_pairs.encode_documents(docs, PATH)
    assert {r.doc_id: r.ids for r in encoded.collect()}[6] == library.encode_ordinary("日😀")
    assert {r.doc_id: bytes(r.data).decode() for r in byte_pairs.decode_documents(encoded, PATH).collect()} == {k: v or "" for k, v in [*texts.items(), (None, "no key")]}
    assert byte_pairs.encode_digests(documents(spark, []), PATH).count() == 0
    broken = documents(spark, [(1, "x")]).withColumn("text", F.unhex(F.lit("61ff62")).cast("string"))
    assert byte_pairs.encode_digests(broken, PATH).first().decoded_sha256 == sha("a�b".encode())
    empty = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(byte_pairs.decode_documents(empty, PATH).first().data) == b""
    with pytest.raises(Exception, match="outside the vocabulary"):
        byte_pairs.decode_documents(spark.createDataFrame([(1, [50_256])], "doc_id long, ids array<int>"), PATH).collect()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_query_against_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op12_byte_pairs(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(ids.tobytes()), sha(texts[r.doc_id].encode()))
