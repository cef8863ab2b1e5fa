"""SentencePiece encoding and decoding with offsets into the original bytes.

* **Normalisation** walks the UTF-8 bytes of a text and at each place replaces
  the longest key of the model's compiled character map (a double-array trie
  with its pool of replacements) that matches there, or copies one character.
  Each normalised byte records the original byte that it came from.
* **Segmentation** of the normalised bytes is the library's, with a copy of the model
  whose own normaliser does nothing, so every id comes from the bytes above.
* **Projection** lays the pieces' lengths along the normalised bytes
  and maps every piece through the alignment to its span of original bytes.

Defined cases: null text is encoded as the empty text, which has no pieces;
very long texts are encoded whole; repeated rows are encoded alike; a null key
stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lorekeep.storage import ship

MARK = "\u2581".encode()


class CharacterMap:
    """Longest-prefix replacement by a compiled character map (may be empty)."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{n // 4}I", blob, 4) if n else ()
        self.pool = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest key at ``at``."""
        if not self.units:
            return None
        unit = self.units[0]
        node, found = self._offset(unit), None
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.pool[value : self.pool.index(b"\0", value)]
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Encoder:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.spec, self.map = pb.NormalizerSpec(), CharacterMap(model.normalizer_spec.precompiled_charsmap)
        self.spec.CopyFrom(model.normalizer_spec)
        plain = model.normalizer_spec
        plain.Clear()
        plain.name = "identity"
        plain.add_dummy_prefix = plain.remove_extra_whitespaces = plain.escape_whitespaces = False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        # Normalised bytes that a piece covers; an unknown piece covers what it says.
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.sizes = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in model.pieces])
        self.decimals = [str(i) for i in range(len(model.pieces))]

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each of them and their end, the original byte."""
        spec, data = self.spec, text.encode()
        space = MARK if spec.escape_whitespaces else b" "
        if not data:
            return b"", np.zeros(1, np.int64)
        if not self.map.units:
            raw, origin = data, np.arange(len(data))
        else:
            parts, froms, at = [], [], 0
            while at < len(data):
                if match := self.map.longest(data, at):
                    size, new = match
                else:
                    size = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                    new = data[at : at + size]
                parts.append(new)
                # A copied character keeps its bytes apart, a replaced one starts at its key.
                froms += [at] * len(new) if match else range(at, at + size)
                at += size
            raw, origin = b"".join(parts), np.array(froms, np.int64)
        codes = np.frombuffer(raw, np.uint8)
        blank = codes == 32
        if spec.remove_extra_whitespaces:
            keep = ~(blank & np.concatenate([[True], blank[:-1]]))
            last = np.flatnonzero(keep & ~blank)
            keep[last[-1] + 1 if len(last) else 0 :] = False
            raw, origin, blank = codes[keep].tobytes(), origin[keep], blank[keep]
            if not raw:
                return b"", np.array([len(data)])
        first = len(space) * bool(spec.add_dummy_prefix)
        aligned = np.concatenate([np.full(first, origin[0]), np.repeat(origin, np.where(blank, len(space), 1)), [len(data)]])
        return space[:first] + raw.replace(b" ", space), aligned

    def encode_spans(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(ids, starts, ends): spans in bytes of the original text, gapless. The
        bytes of a character that fell back to byte pieces go to one piece each;
        a mark that the model puts before the text has an empty span."""
        normalised, origin = self.normalise(text)
        ids = self.segmenter.encode(normalised.decode()) if normalised else []
        if not ids:
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = self.sizes[ids]
        if self.unknown in ids:
            sizes = np.array([len(p.encode()) if i == self.unknown else n for i, n, p in zip(ids, sizes, self.segmenter.encode(normalised.decode(), out_type=str))])
        ends = np.minimum(np.cumsum(sizes), len(normalised))
        return ids, origin[np.append(0, ends[:-1])], origin[ends]

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _digests(path: str):
    def run(batches):
        e = encoder(path)
        names = ["key", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "ends_crc32"]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids, _, ends = e.encode_spans(text.as_py() or "")
                joined = ",".join([e.decimals[i] for i in ids])
                decoded = e.decode(ids)
                rows.append((len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), int(ends[-1]) if ids else 0, zlib.crc32(ends.astype("<i8").tobytes())))
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names)

    return run


def _pieces(path: str):
    def run(batches):
        e = encoder(path)
        kind = pa.list_(pa.struct([("id", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = [[{"id": i, "start": int(a), "end": int(b)} for i, a, b in zip(*e.encode_spans(t.as_py() or ""))] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["key", "pieces"])

    return run


def encode_documents(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, pieces array<struct<id, start, end>>): spans in original UTF-8 bytes."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(_pieces(model), f"key {kind}, pieces array<struct<id:int,start:bigint,end:bigint>>").withColumnRenamed("key", key)


def encode_digests(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, n_bytes, ends_crc32): the same
    without shipping the pieces; ``ends_crc32`` is over their 8-byte ends."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(_digests(model), f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint, ends_crc32 bigint").withColumnRenamed("key", key)
