"""Vectorised 64-bit hashes of the words of many texts at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed together up to this many bytes; longer ones in parts cut at spaces.
BLOCK = 1 << 20
#: Words up to this many bytes are hashed side by side.
CHAINED = 256
_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the multiplier and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, BLOCK + 1)
        for k, m in enumerate((_ODD, _INVERSE)):
            p = np.full(size, m, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of (byte + 1) * m ** position over i..j-1."""
    up, _ = powers(len(data))
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=h[1:])
    return h


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes: eight bytes at a time are mixed into a
    state, which has no linear structure that texts could cancel; the hash of a
    span beyond ``CHAINED`` bytes is cryptographic."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = end - start
    h = mixed((size.astype(np.uint64) + np.uint64(1)) * _ODD)
    live, at = np.flatnonzero((size > 0) & (size <= CHAINED)), 0
    while len(live):
        rest = size[live] - at
        chunk = eights[start[live] + at]
        short = rest < 8
        chunk[short] &= (np.uint64(1) << (np.uint64(8) * rest[short].astype(np.uint64))) - np.uint64(1)
        h[live] = mixed((h[live] ^ chunk) * _ODD + np.uint64(at))
        live, at = live[rest > 8], at + 8
    for i in np.flatnonzero(size > CHAINED).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def keyed_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: bytes) -> np.ndarray:
    """64 bits of keyed BLAKE2b of spans of bytes, once for each distinct span: who does not know
    the key cannot make two words that share one."""
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.arange(at[-1]) + np.repeat(start - at[:-1], size)]
    coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(flat)]).dictionary_encode()
    digests = b"".join([hashlib.blake2b(w, digest_size=8, key=key).digest() for w in coded.dictionary.to_pylist()])
    return np.frombuffer(digests, "<u8").astype(np.uint64)[coded.indices.to_numpy()]


def _words(data: np.ndarray, cuts: np.ndarray, key: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text); texts end at ``cuts``."""
    inside = ~SPACE[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    first = np.zeros(len(data) + 1, bool)
    first[cuts[:-1]] = True
    first = first[:-1]
    starts = np.flatnonzero(inside & (~before | first))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:] & ~first[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    counts = np.diff(np.searchsorted(starts, cuts))
    return (keyed_hash(data, starts, ends, key) if key else spans_hash(data, starts, ends)), counts


def _long(data: np.ndarray, key: bytes | None = None) -> np.ndarray:
    """Word hashes of one long text, a part at a time."""
    out, at = [], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data):
            spaces = np.flatnonzero(SPACE[data[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:  # one very long word: it is hashed whole
                rest = np.flatnonzero(SPACE[data[end:]])
                end = end + int(rest[0]) if len(rest) else len(data)
        out.append(_words(data[at:end], np.array([0, end - at]), key)[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows (null: empty)."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - (offsets[0] if len(offsets) else 0)


def blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most BLOCK bytes together, or a single longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _cut(data: np.ndarray, a: int, b: int, block: int) -> int:
    """The last place within a block where white space follows a visible sign (both of
    ASCII), or the first such place after it."""
    at = a
    while at < b:
        part = data[at : min(at + block, b)]
        found = np.flatnonzero(((part[1:] == 32) | (part[1:] == 10)) & (part[:-1] > 32) & (part[:-1] < 127))
        if len(found):
            return at + int(found[-1 if at == a else 0]) + 1
        at += max(1, block - 1)
    return b


def text_parts(data: np.ndarray, offsets: np.ndarray, block: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (row, first byte, end) of texts, at most ``block`` bytes together. Longer
    texts are cut before white space, so only an unbroken stretch can be longer."""
    held, size = [], 0
    for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while a < b:
            end = b if b - a <= block else _cut(data, a, b, block)
            if held and size + end - a > block:
                yield held
                held, size = [], 0
            held.append((r, a, end))
            size, a = size + end - a, end
    if held:
        yield held


def word_hashes(column: pa.Array, lower: bool = False, key: bytes | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For ranges of rows: (first row, hashes of all their words, words of each row)."""
    data, offsets = text_bytes(column)
    for i, j in blocks(offsets):
        part = data[offsets[i] : offsets[j]]
        if lower:
            part = LOWER[part]
        if not len(part):
            yield i, np.zeros(0, np.uint64), np.zeros(j - i, np.int64)
        elif len(part) > BLOCK:
            h = _long(part, key)
            yield i, h, np.array([len(h)])
        else:
            yield i, *_words(part, offsets[i : j + 1] - offsets[i], key)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    size_here = min(size, len(words))
    n = len(words) - size_here + 1
    out = np.full(n, size_here, np.uint64)
    for k in range(size_here):
        out = mixed(out * _ODD + words[k : k + n])
    return out
