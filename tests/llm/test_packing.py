import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lorekeep.llm import packing
from lorekeep.llm.queries import op8_packing
from tests.llm.common import SF, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts):
    """Every id of every document in exactly one piece; sequences full or a power of two."""
    library, docs, sequences = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == 2048 or at < 2048 and at & (at - 1) == 0
    assert docs.keys() == texts.keys()
    for i, pieces in docs.items():
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    return sequences


def test_words_encode_as_the_library_does():
    library, e = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    texts = ["", " ", "It's 12'll x\x1cy\x85z", "Σας ΣΑΣ İ é  　 ﬁ½", "<|endoftext|> a", "''s 's't d'd 'D 'S", "日本語 テ 😀😀!?\n\n\t_", "a" * 500]
    for t in texts:
        assert np.frombuffer(e.encode(t), f"<u{e.width}").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_random_unicode_encodes_as_the_library_does():
    r, library, e = random.Random(1), Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    every = [c for c in map(chr, range(0x20000)) if not 0xD800 <= ord(c) < 0xE000]
    pools = [every[32:127], every[:0x250], [*every[0x300:0x370], *"aeoIİıΣσςéñ\u0307"], every[0x370:0x600], every[0x1E00:0x2100], every[::97], list("'s 't'RE'LL ’\t\n\r\x0b\x85\xa0 ")]
    texts = ["".join(r.choice(r.choice(two)) for _ in range(r.randint(0, 14))) for two in (r.choices(pools, k=2) for _ in range(30_000))]
    texts += ["\u0130\u0347", "a<|startoftext|>B", "<|ENDOFTEXT|>", "\n\n", ""]
    for t, ids in zip(texts, e.encode_all(pa.array(texts))):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, ascii(t)


def test_remembered_words_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 20_000)
    monkeypatch.setattr(packing, "PARTS", 10_000)
    monkeypatch.setattr(packing, "BLOCK", 50_000)
    r, library, e = random.Random(2), Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    texts = [" ".join("".join(r.choices("abcdé", k=n)) for n in (5, 9, 20_000)) for _ in range(20)]
    for t, ids in zip(texts, e.encode_all(pa.array(texts))):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
    assert e.held <= 10_000 and max(map(len, [*e.words, *e.parts])) <= packing.SHORT
    assert len(e.words) * packing.OVERHEAD <= 20_000 + 100 * packing.OVERHEAD


def test_hilbert_neighbours_touch():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    index = packing.hilbert(cells, 3)
    assert sorted(index.tolist()) == list(range(512))
    along = cells[np.argsort(index)]
    assert (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()


def test_powers():
    assert packing.powers(0) == [] and packing.powers(1000) == [512, 256, 128, 64, 32, 8]


def test_edge_rows(spark):
    texts = {1: "one two three", 2: None, 3: "", 4: "long " * 9000, 5: "one two three"}
    out = packing.pack(documents(spark, [(k, t) for k, t in texts.items()], extra=True), PATH)
    from pyspark.sql import functions as F

    rows = out.withColumn("ids_crc32", F.crc32("ids")).collect()
    check(rows, texts)
    assert packing.pack(documents(spark, []), PATH).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_query_against_the_library(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(op8_packing(spark, SF).collect(), texts)
