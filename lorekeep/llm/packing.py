"""Packing along a space-filling curve.

Every document is tokenised once; its ids are hashed into a vector, which fixed
pseudo-random signs project to a few dimensions. The cell of the projected
point gives a Hilbert key. Documents are range-partitioned and sorted by that
key (then by document key, which splits groups of copies), and each partition
is cut along the curve into full sequences, so neighbours share sequences. What
is left at a partition's end is cut into powers of two, which need no padding.

The ids are written once to the shared folder before the range partitioning,
so sampling its bounds does not tokenise again. Memory a task: the words a
worker remembers (bounded in bytes), a block of texts or one longer text, one
open sequence and one Arrow batch.

Defined cases: null or empty text is the end id alone; a document longer than a
sequence is cut and every id lies in exactly one piece; repeated rows are packed
each; a null key sorts first; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lorekeep.llm.hashing import mixed
from lorekeep.storage import materialise, ship

LENGTH = 2048
END = 1
DIMENSIONS, BITS, HASHED = 3, 10, 256
#: Bytes of text that are encoded together, of parts and of words that a worker
#: remembers (none longer than ``SHORT`` letters), and what each takes beside its letters.
BLOCK, PARTS, WORDS, SHORT, OVERHEAD = 8 << 20, 40 << 20, 80 << 20, 64, 220
#: The pre-tokeniser's pattern for lower-case ASCII; then the line end between words.
PATTERN = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^\s0-9a-z]+|\n", re.ASCII)


def ragged(values: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` that ``index`` names, one after another, and their offsets."""
    sizes = np.diff(offsets)[index]
    out = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.arange(out[-1]) + np.repeat(offsets[index] - out[:-1], sizes)], out


class WordEncoder:
    """Ids of a lower-casing word tokenizer whose words carry an end mark.

    A word's ids do not depend on its neighbours. So the distinct words of a block
    that are not yet known are normalised and cut into parts together (by the
    library's own normaliser and pre-tokeniser beyond ASCII), each distinct part goes
    to the model once, and texts are put together from words by position."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.pre_tokenizer = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.compose, self.lower = normalizers.NFC(), normalizers.Lowercase()
        size = max(self.tokenizer.get_vocab().values()) + 1
        self.width, self.letter = (2, "H") if size <= 1 << 16 else (4, "I")
        self.kind = f"<u{self.width}"
        self.cells = (mixed(np.arange(size, dtype=np.uint64)) >> np.uint64(56)).astype(np.int64) % HASHED
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts: dict[str, bytes] = {}
        self.held = 0
        self._forget()

    def _forget(self) -> None:
        """Empties the table of words: their numbers, ids and these' offsets."""
        self.words: dict[str, int] = {}
        self.values, self.offsets, self.used = np.zeros(0, self.kind), np.zeros(1, np.int64), 0

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _part(self, part: str) -> bytes:
        ids = array(self.letter, [t.id for t in self.model.tokenize(part)]).tobytes()
        if len(part) <= SHORT:
            self.held += OVERHEAD + len(part)
            if self.held > PARTS:
                self.parts.clear()
                self.held = OVERHEAD + len(part)
            self.parts[part] = ids
        return ids

    def _ids(self, parts: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given their parts, ``counts`` of them a word, and the words' offsets."""
        coded = pa.array(parts, pa.string()).dictionary_encode()
        known = self.parts
        ids = [known.get(x) or self._part(x) for x in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        sizes = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]) // self.width
        values, at = ragged(np.frombuffer(b"".join(ids), self.kind), sizes, coded.indices.to_numpy())
        return values, at[np.concatenate([[0], np.cumsum(counts)])]

    def _plain_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of printable ASCII, which are their own byte-level spelling."""
        parts = PATTERN.findall("\n".join([*words, ""]).lower())
        ends = np.flatnonzero(np.array([x == "\n" for x in parts], bool))
        return self._ids([x for x in parts if x != "\n"], np.diff(np.concatenate([[-1], ends])) - 1)

    def _other_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = self.lower.normalize_str(self.compose.normalize_str("\n".join([*words, ""])))
        parts = self.pre_tokenizer.pre_tokenize_str(text)
        ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 10)
        counts = np.diff(np.concatenate([[0], np.searchsorted([start for _, (start, _) in parts], ends)]))
        return self._ids([x for x, _ in parts], counts)

    def _learn(self, words: list[str]) -> np.ndarray:
        """The numbers of new words, which are remembered."""
        number = np.empty(len(words), np.int64)
        plain = np.array([w.isascii() and w.isprintable() for w in words], bool)
        for own, ids in ((np.flatnonzero(plain), self._plain_words), (np.flatnonzero(~plain), self._other_words)):
            if len(own):
                values, offsets = ids([words[i] for i in own])
                number[own] = len(self.offsets) - 1 + np.arange(len(own))
                self.values = np.concatenate([self.values, values])
                self.offsets = np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
        self.words.update((w, i) for w, i in zip(words, number.tolist()) if len(w) <= SHORT)
        self.used += sum(map(len, words)) + OVERHEAD * len(words)
        return number

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts and their offsets."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.used > WORDS:
            self._forget()
        number = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = self._learn([words[i] for i in new.tolist()])
        values, at = ragged(self.values, self.offsets, number[coded.indices.to_numpy()])
        return values, at[split.offsets.to_numpy() - split.offsets[0].as_py()]

    def encode_all(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a column without nulls."""
        column = column.cast(pa.large_string())
        sizes = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))])
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + BLOCK, "right")) - 1)
            texts = column.slice(i, j - i)
            marked = {k for s in self.special for k in np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False)).tolist()}
            values, at = self._block(texts)
            for k in range(j - i):
                yield self.plain(texts[k].as_py()) if k in marked else values[at[k] : at[k + 1]]
            i = j

    def encode(self, text: str) -> bytes:
        """Little-endian ids of a whole text, ``width`` bytes each."""
        return next(self.encode_all(pa.array([text]))).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(maxsize=1)
def _signs(dimensions: int) -> np.ndarray:
    cells = mixed(np.arange(1, HASHED * dimensions + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (cells >> np.uint64(63)).astype(np.float64).reshape(HASHED, dimensions) * 2 - 1


def project(counts: np.ndarray, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Cells of documents given their hashed counts: root frequencies scaled to
    length one, projected by fixed signs; a squashing spreads them over the cells."""
    v = np.sqrt(counts)
    p = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) @ _signs(dimensions)
    cells = np.floor((np.tanh(0.8 * p) + 1) / 2 * (1 << bits)).astype(np.int64)
    return np.clip(cells, 0, (1 << bits) - 1)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Indexes of rows of cells along the Hilbert curve (Skilling, 2004)."""
    x = [c.copy() for c in cells.T]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            flip = x[i] & q != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(flip, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q != 0, q - 1, 0)
        q >>= 1
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | ((v ^ t) >> b & 1)
    return index


def _encode(path: str, end: int):
    def run(batches):
        e = encoder(path)
        tail = np.array([end], f"<u{e.width}").tobytes()
        for batch in batches:
            tokens, counts = [], np.zeros((batch.num_rows, HASHED))
            for k, ids in enumerate(e.encode_all(pc.fill_null(batch.column(1), ""))):
                counts[k] = np.bincount(e.cells[ids], minlength=HASHED)
                tokens.append(ids.tobytes() + tail)
            keys = hilbert(project(counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(tokens, pa.binary()), pa.array([e.width] * len(keys), pa.int32())], ["key", "curve", "ids", "width"])

    return run


def powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _pack(length: int, kind: pa.DataType):
    names = ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches):
        base, sequence = TaskContext.get().partitionId() << 40, 0
        used, opened, rows = 0, [], []
        for b in batches:
            for key, ids, width in zip(b.column(0).to_pylist(), b.column(2), b.column(3).to_pylist()):
                ids = np.frombuffer(ids.as_py(), f"<u{width}").astype("<u4").tobytes()
                total, start = len(ids) // 4, 0
                while start < total:
                    n = min(length - used, total - start)
                    opened.append((key, start, n, ids[4 * start : 4 * (start + n)], total, used))
                    start, used = start + n, used + n
                    if used == length:
                        rows += [(*p[:5], base | sequence, p[5]) for p in opened]
                        sequence, used, opened = sequence + 1, 0, []
                        if len(rows) >= 2000:
                            yield batch(rows)
                            rows = []
        # The rest: pieces are cut again where a power of two ends.
        sizes = powers(used)
        room, at = (sizes[0] if sizes else 0), 0
        for key, start, n, ids, total, _ in opened:
            while n:
                m = min(n, room - at)
                rows.append((key, start, m, ids[: 4 * m], total, base | sequence, at))
                start, n, ids, at = start + m, n - m, ids[4 * m :], at + m
                if at == room:
                    sequence, at = sequence + 1, 0
                    sizes.pop(0)
                    room = sizes[0] if sizes else 0
        if rows:
            yield batch(rows)

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a piece: (key, start, length, ids, doc_tokens, sequence_id, offset);
    ``ids`` are little-endian unsigned 32-bit, sequences full or a power of two long."""
    from pyspark.sql.pandas.types import to_arrow_type

    ship(docs.sparkSession)
    kind = docs.schema[key].dataType
    encoded = materialise(docs.select(key, text).mapInArrow(_encode(tokenizer, end), f"key {kind.simpleString()}, curve bigint, ids binary, width int"), "token-ids")
    ordered = encoded.repartitionByRange("curve", "key").sortWithinPartitions("curve", "key", "ids")
    schema = f"key {kind.simpleString()}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return ordered.mapInArrow(_pack(length, to_arrow_type(kind)), schema).withColumnRenamed("key", key)
