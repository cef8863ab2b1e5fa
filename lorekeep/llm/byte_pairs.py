"""Byte-level BPE encoding and decoding by the ranks of a vocabulary.

Texts are encoded a block at a time:

* **Splitting.** Every match of ``public_tokenizers.PATTERN`` is found by position: runs of
  letters, numbers, other signs and white space, a space before a run, contractions.
  The classes of characters are asked of the library's own pattern engine, whose
  tables are of another Unicode version than Python's.
* **Merging.** Distinct pieces that are no token as a whole are put into padded
  matrices, one for each bucket of lengths. Each round looks up the pairs that are new
  in a hash table, merges every row's leftmost pair of least rank and closes the
  gaps; rows without a pair leave. A piece beyond ``WIDEST`` bytes would take as many rounds
  as it has bytes, each over all of it; its pairs wait in a heap instead.
* **Decoding** lays the tokens' bytes one after another.

Memory a task: the vocabulary, one block of texts and its pieces. A long text is cut
where white space follows a letter, a digit or a sign of ASCII, which always parts two
matches, so only an unbroken stretch can be longer than a block.

Defined cases: null text is encoded as the empty text, which has no ids; bytes that are
no UTF-8 count as replacement characters; very long texts are encoded whole; repeated
rows are encoded alike; a null key stays null; an empty table gives an empty result;
other columns are ignored. Decoding: a null list gives no bytes, an id outside the
vocabulary fails the job.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.hashing import mixed, text_bytes, text_parts
from lorekeep.llm.packing import ragged
from lorekeep.storage import ship

#: Bytes of text that are encoded together; cells of a matrix; the longest piece in a matrix.
BLOCK, CELLS, WIDEST = 4 << 20, 1 << 20, 1024
NONE = np.iinfo(np.int32).max
OTHER, LETTER, NUMBER, SPACE = range(4)


class Pairs:
    """(left id, right id) -> id of their concatenation: open addressing, linear probing."""

    def __init__(self, found: dict[tuple[int, int], int]):
        keys = np.array([a << 32 | b for a, b in found], np.uint64)
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values = np.full(size, 2**64 - 1, np.uint64), np.full(size, NONE, np.int32)
        self.mask, values = np.int64(size - 1), np.array(list(found.values()), np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):  # of several keys that want one free slot the last stays there
            free = left[self.keys[slot[left]] == np.uint64(2**64 - 1)]
            self.keys[slot[free]] = keys[free]
            own = left[self.keys[slot[left]] == keys[left]]
            self.values[slot[own]] = values[own]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of pairs, ``NONE`` where there is none (or an id is -1)."""
        keys = left.astype(np.uint64) << np.uint64(32) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        out, slot = np.full(len(keys), NONE, np.int32), self._slot(keys)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        while len(open_):
            held, wanted = self.keys[slot[open_]], keys[open_]
            hit = held == wanted
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held != np.uint64(2**64 - 1))]
            slot[open_] = (slot[open_] + 1) & self.mask
        return out


class BytePairEncoder:
    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().splitlines()))}
        self.tokens = sorted(ranks, key=ranks.get)
        if [ranks[t] for t in self.tokens] != list(range(len(ranks))):
            raise ValueError("the ranks of a vocabulary are 0, 1, 2, ... without a gap")
        self.vocabulary = pa.array(self.tokens, pa.large_binary())
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.ends = np.concatenate([[0], np.cumsum([len(t) for t in self.tokens])])
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        found = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    found[a, b] = rank
        self.pairs = Pairs(found)
        self.classes = np.zeros(0x110000, np.uint8)
        every = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4").tobytes().decode("utf-32-le")
        plain = {bytes([b]): b for b in range(256)}
        for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
            own = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=plain, special_tokens={})
            self.classes[np.frombuffer(bytes(own.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4")] = kind

    def piece_starts(self, codes: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Which characters begin a match; ``texts`` are the first characters of texts."""
        n, kind = len(codes), self.classes[codes]
        first = np.zeros(n + 3, bool)
        first[texts] = True
        starts = first.copy()
        starts[1:n] |= kind[1:] != kind[:-1]
        run = starts.copy()
        # The last of several blanks before a run parts from the others; a space joins the run.
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n])
        starts[last] = True
        starts[last[codes[last] == 32] + 1] = False
        # A contraction is an apostrophe that begins a match, and what letters it takes.
        padded = np.concatenate([codes, np.zeros(3, codes.dtype)])
        mark = np.flatnonzero((codes == 39) & starts[:n])
        mark = mark[(run[mark + 1]) & (mark + 1 < n) & ~first[mark + 1]]
        one = mark[np.isin(padded[mark + 1], [ord(c) for c in "stmd"])]
        two = mark[~first[mark + 2] & np.isin(padded[mark + 1].astype(np.uint64) << np.uint64(32) | padded[mark + 2], [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]
        starts[one + 1] = starts[two + 1] = False
        starts[one + 2] = starts[two + 3] = True
        return starts[:n]

    def _merged(self, pieces: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(piece numbers, ids a piece, ids) of pieces, as their rows leave the matrices."""
        size = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(size, kind="stable")
        for i in order[size[order] > WIDEST].tolist():
            ids = self._merged_by_heap(pieces[i])
            yield np.array([i]), np.array([len(ids)]), np.array(ids, np.int32)
        order = order[size[order] <= WIDEST]
        at = 0
        while at < len(order):
            widest = 1 << int(size[order[at]] - 1).bit_length() if size[order[at]] > 1 else 1
            end = min(int(np.searchsorted(size[order], widest, "right")), at + max(1, CELLS // widest))
            yield from self._bucket(order[at:end], [pieces[i] for i in order[at:end].tolist()], size[order[at:end]])
            at = end

    def _bucket(self, number: np.ndarray, pieces: list[bytes], size: np.ndarray):
        width = int(size.max())
        inside = np.arange(width) < size[:, None]
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[inside] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full(ids.shape, NONE, np.int32)  # of the pair that begins in a cell
        if width > 1:
            ranks[:, :-1] = self.pairs.look_up(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, width - 1)
        while len(number):
            place = ranks.argmin(1)
            row = np.arange(len(number))
            best = ranks[row, place]
            done = best == NONE
            if done.any():
                out = ids[done]
                kept = out >= 0
                yield number[done], kept.sum(1), out[kept]
                stay = ~done
                number, ids, ranks, place, best = number[stay], ids[stay], ranks[stay], place[stay], best[stay]
                row = np.arange(len(number))
            if not len(number):
                return
            ids[row, place] = best
            gap = np.ones(ids.shape, bool)
            gap[row, place + 1] = False
            width = ids.shape[1] - 1
            ids, ranks = ids[gap].reshape(-1, width), ranks[gap].reshape(-1, width)
            after = np.where(place + 1 < width, ids[row, np.minimum(place + 1, width - 1)], -1)
            ranks[row, place] = self.pairs.look_up(best, after)
            inner = np.flatnonzero(place > 0)
            ranks[inner, place[inner] - 1] = self.pairs.look_up(ids[inner, place[inner] - 1], best[inner])

    def _merged_by_heap(self, piece: bytes) -> list[int]:
        """The same merges of one very long piece: the least rank first, then the leftmost."""
        ids = self.single[np.frombuffer(piece, np.uint8)]
        first = self.pairs.look_up(ids[:-1], ids[1:])
        some = np.flatnonzero(first < NONE)
        heap = list(zip(first[some].tolist(), some.tolist()))
        heapq.heapify(heap)
        ids, n = ids.tolist(), len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = first.tolist()
        known: dict[tuple[int, int], int] = {}

        def rank(i: int) -> int:
            key = ids[i], ids[after[i]]
            if key not in known:
                known[key] = int(self.pairs.look_up(np.array(key[:1], np.int32), np.array(key[1:], np.int32))[0])
            return known[key]

        pair.append(NONE)
        while heap:
            best, i = heapq.heappop(heap)
            if ids[i] < 0 or pair[i] != best:
                continue
            gone = after[i]
            ids[i], ids[gone] = best, -1
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0:
                    pair[k] = rank(k) if after[k] < n else NONE
                    if pair[k] < NONE:
                        heapq.heappush(heap, (pair[k], k))
        return [i for i in ids if i >= 0]

    def encode_block(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie one after another, and their n + 1 offsets. The texts' bytes
        end at ``cuts``, whose first is 0; none is empty."""
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        heads = np.flatnonzero(data & 0xC0 != 0x80)
        starts = heads[self.piece_starts(codes, np.searchsorted(heads, cuts[:-1]))]
        bounds = np.append(starts, len(data)).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        distinct = coded.dictionary
        whole = pc.index_in(distinct, value_set=self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(whole < 0)
        sizes = np.ones(len(distinct), np.int64)
        merged = list(self._merged(distinct.take(pa.array(new)).to_pylist()))
        for number, count, _ in merged:
            sizes[new[number]] = count
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        values = np.empty(offsets[-1], np.int32)
        values[offsets[:-1][whole >= 0]] = whole[whole >= 0]
        for number, count, ids in merged:
            to = offsets[new[number]]
            values[np.arange(len(ids)) + np.repeat(to - (np.cumsum(count) - count), count)] = ids
        ids, at = ragged(values, offsets, coded.indices.to_numpy())
        return ids.astype("<u4"), at[np.searchsorted(bounds, cuts)]

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of the texts of a string column; a long text comes in several parts."""
        data, offsets = text_bytes(column)
        for parts in text_parts(data, offsets, BLOCK):
            rows = [r for r, _, _ in parts]
            pieces = [_valid(data[a:b]) for _, a, b in parts]
            cuts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
            ids, at = self.encode_block(np.concatenate(pieces), cuts)
            for r, i, j in zip(rows, at[:-1].tolist(), at[1:].tolist()):
                yield r, ids[i:j]

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, "<u4"), *(ids for _, ids in self.encode_column(pa.array([text])))])

    def decode(self, ids: np.ndarray) -> bytes:
        return ragged(self.bytes, self.ends, ids.astype(np.int64))[0].tobytes()


def _valid(data: np.ndarray) -> np.ndarray:
    try:
        data.tobytes().decode()
    except UnicodeDecodeError:
        return np.frombuffer(data.tobytes().decode(errors="replace").encode(), np.uint8)
    return data


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairEncoder:
    return BytePairEncoder(path)


def _digests(path: str):
    def run(batches):
        e = encoder(path)
        for batch in batches:
            n = batch.num_rows
            count, ids, texts = [0] * n, [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
            for row, part in e.encode_column(batch.column(1)):
                count[row] += len(part)
                ids[row].update(part.tobytes())
                texts[row].update(e.decode(part))
            columns = [pa.array(count, pa.int64()), *(pa.array([h.hexdigest() for h in hs], pa.string()) for hs in (ids, texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str):
    def run(batches):
        e = encoder(path)
        for batch in batches:
            rows = [[] for _ in range(batch.num_rows)]
            for row, part in e.encode_column(batch.column(1)):
                rows[row].append(part)
            lists = [np.concatenate(r).astype(np.int32) if r else np.zeros(0, np.int32) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], ["key", "ids"])

    return run


def _texts(path: str):
    def run(batches):
        e = encoder(path)
        for batch in batches:
            out = []
            for ids in batch.column(1):
                ids = np.array(ids.as_py() or [], np.int64)
                if len(ids) and not 0 <= ids.min() <= ids.max() < len(e.tokens):
                    raise ValueError("an id outside the vocabulary")
                out.append(e.decode(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["key", "data"])

    return run


def encode_documents(docs: DataFrame, ranks: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>): every whole text by the ranks in the file ``ranks``."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(_ids(ranks), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode_documents(encoded: DataFrame, ranks: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, data binary): the bytes of the ids, which need not be whole characters."""
    ship(encoded.sparkSession)
    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, F.col(ids).cast("array<bigint>")).mapInArrow(_texts(ranks), f"key {kind}, data binary").withColumnRenamed("key", key)


def encode_digests(docs: DataFrame, ranks: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) without shipping the ids: digests of the
    ids as little-endian unsigned 32-bit integers, and of the bytes that they decode to."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(_digests(ranks), f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
