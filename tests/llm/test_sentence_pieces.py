import hashlib
import os
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from lorekeep.llm import sentence_pieces
from lorekeep.llm.queries import op9_sentence_pieces
from tests.llm.common import SF, documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_spans_tile_the_text():
    e = sentence_pieces.Encoder(PATH)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(1)
    texts = ["", " ", "  ", "a  b", " a", "a ", "\n\n \t x", "日本語 テキスト", "emoji 😀😀 x", "▁a ▁ b", "<s> </s> <unk> <0x41>", "\0x", "ﬁ ½ ́e", "a" * 5000, " " * 300 + "x"]
    texts += ["".join(rng.choice("ab  \n▁é日😀the in<>0x41/s") for _ in range(rng.randrange(60))) for _ in range(500)]
    for t in texts:
        ids, starts, ends = e.encode_spans(t)
        assert ids == library.encode(t)
        data, at = t.encode(), 0
        for i, a, b in zip(ids, starts.tolist(), ends.tolist()):
            assert a == at <= b
            piece = library.id_to_piece(i)
            if not piece.startswith("<0x") and a < b:
                assert data[a:b].decode() == piece.replace("▁", " ") or piece.replace("▁", " ")[1:] == data[a:b].decode() or "▁" in t
            at = b
        assert at == len(data) or not ids


def trie(keys):
    """A compiled character map: a double array laid out by plain search."""
    tree, pool = {}, b""
    for k, v in keys.items():
        node = tree
        for b in k.encode():
            node = node.setdefault(b, {})
        node[None] = len(pool)
        pool += v.encode() + b"\0"
    units, used = {0: 0}, {0}

    def lay(node, at, label):
        labels = [0 if b is None else b for b in node]
        offset = next(o for o in range(1, 1 << 20) if all((at ^ o ^ x) not in used for x in labels))
        used.update(at ^ offset ^ x for x in labels)
        units[at] = offset << 10 | (1 << 8 if None in node else 0) | label
        for b, child in node.items():
            to = at ^ offset ^ (0 if b is None else b)
            if b is None:
                units[to] = 1 << 31 | child
            else:
                lay(child, to, b)

    lay(tree, 0, 0)
    n = (max(units) // 256 + 2) * 256
    table = [units.get(i, 0) for i in range(n)]
    return struct.pack("<I", 4 * n) + struct.pack(f"<{n}I", *table) + pool


def test_character_map_takes_the_longest_prefix():
    m = sentence_pieces.CharacterMap(trie({"a": "x", "ab": "yz", "é": "e", "abcd": ""}))
    assert m.longest(b"abc", 0) == (2, b"yz") and m.longest(b"abcd", 0) == (4, b"") and m.longest(b"b", 0) is None
    assert m.longest("xé".encode(), 1) == (2, b"e")


def test_alignment_through_a_character_map():
    e = sentence_pieces.Encoder(PATH)
    e.map = sentence_pieces.CharacterMap(trie({"ab": "Q", "é": "ee"}))
    text, origin = e.normalise("abé b")
    assert text.decode() == "▁Qee▁b"
    assert origin.tolist() == [0, 0, 0, 0, 2, 2, 4, 4, 4, 5, 6]
    e.spec.remove_extra_whitespaces = True
    text, origin = e.normalise("  a   b ")
    assert text.decode() == "▁a▁b" and origin.tolist() == [2, 2, 2, 2, 3, 3, 3, 6, 8]


def test_ids_come_from_the_map_as_in_the_library(tmp_path):
    """A model whose compiled map is not empty, with each setting of white space."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    rng = random.Random(4)
    texts = ["abé b", "  the  THE \u3000x ", "ABCD" * 50, " ", "", "\u3000"]
    texts += ["".join(rng.choice("abcdTHE  é日\u3000😀\n") for _ in range(rng.randrange(40))) for _ in range(300)]
    for k, (squeeze, dummy) in enumerate(((False, True), (True, True), (True, False), (False, False))):
        model.normalizer_spec.precompiled_charsmap = trie({"ab": "Q", "abc": "x", "é": "ee", "T": "t", "THE": "the", "\u3000": " ", "\n": ""})
        model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.add_dummy_prefix = squeeze, dummy
        path = tmp_path / f"{k}.model"
        path.write_bytes(model.SerializeToString())
        e, library = sentence_pieces.Encoder(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
        for t in texts:
            ids, starts, ends = e.encode_spans(t)
            assert ids == library.encode(t), (t, squeeze, dummy)
            assert (starts[1:] == ends[:-1]).all() and (starts <= ends).all() and (not ids or ends[-1] == len(t.encode()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_query_against_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op9_sentence_pieces(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.n_bytes == len(texts[r.doc_id].encode())
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {1: None, 2: "", 3: "some text\nof two lines", 4: "long text " * 8000, 5: "some text\nof two lines"}
    docs = documents(spark, texts.items(), extra=True)
    for r in sentence_pieces.encode_digests(docs, PATH).collect():
        ids = library.encode(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.n_bytes == len((texts[r.doc_id] or "").encode())
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    pieces = {r.doc_id: r.pieces for r in sentence_pieces.encode_documents(docs, PATH).collect()}
    assert [p.id for p in pieces[3]] == library.encode(texts[3]) and pieces[1] == []
    assert sentence_pieces.encode_digests(documents(spark, []), PATH).count() == 0
    assert np.array([p.end for p in pieces[3]]).max() == len(texts[3])
