"""Suffix-array deduplication of long repeated substrings.

A byte goes if a string of ``length`` (400) bytes that covers it also starts
anywhere else in the corpus. Sorting every suffix of a corpus is not needed for
that: each window of 400 bytes belongs to one anchor, the gram of 200 bytes in
it with the least hash (leftmost on ties), so equal windows have equal anchors
at the same place, and only suffixes that start at anchors are sorted.

1. One pass finds the anchors (about one in a hundred bytes) with the run of windows
   each governs, the gram's hash and a digest of the context, that is all bytes of
   those windows. Anchors whose hash occurs once are dropped.
2. A hash whose contexts are all alike covers them whole. Elsewhere members with equal contexts
   collapse to one representative with a count (aggregated before the shuffle), which
   fetches its context from one of equal texts. Groups of more than ``MOST`` representatives
   are split by ever longer shared strings, down to single windows.
3. Representatives are partitioned by hash, and each group is sorted twice,
   by the text to the right of the gram and by that to the left read backwards:
   multikey quicksort to a shallow depth, then a blind trie for every group with a
   longer common prefix. The orders come with their longest common prefixes.
   A window that begins d bytes before the gram is repeated if another member
   shares 200 - d bytes on the right and d on the left, that is if two
   members fall into the same run of both orders at those depths.
4. Covered ranges go back to all members, and each text is cut once.

Defined cases: null text is empty; texts shorter than a window lose nothing;
matches never cross documents but may overlap inside one; rows repeated with
equal texts repeat each other, so long ones vanish; cuts fall on bytes, not
characters; a null key stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.hashing import BLOCK, blocks, mixed, powers, prefix_sums, text_bytes
from lorekeep.storage import materialise, ship

LENGTH, GRAM = 400, 200
SHALLOW = 12
#: Unlike contexts of a gram that one task sorts.
MOST = 2_000
_RANGES = "h bigint, c bigint, ranges array<struct<lo:bigint,hi:bigint>>"


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """Minima of all runs of ``size`` entries (van Herk's two scans)."""
    n = len(x) - size + 1
    padded = np.full(-(-len(x) // size) * size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(-1, size)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[size - 1 : size - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, anchor, first window, last window) of all runs of windows in at most
    BLOCK bytes; ``ends`` holds for each byte where its text ends."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    h = prefix_sums(data)
    _, down = powers(len(data))
    grams = mixed((h[gram:] - h[:-gram]) * down[: len(data) - gram + 1])
    low = np.uint64((1 << 20) - 1)
    places = np.arange(len(grams), dtype=np.uint64)
    least = (sliding_least((grams & ~low) | places, length - gram + 1) & low).astype(np.int64)
    starts = np.flatnonzero(ends[: len(least)] >= np.arange(len(least)) + length)
    if not len(starts):
        return none, none, none, none
    p = least[starts]
    cut = np.concatenate([[True], (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(p)) - 1
    return grams[p[first]].view(np.int64), p[first], starts[first], starts[last]


def _anchors(length: int, gram: int):
    names = ["th", "h", "c", "p", "a", "b"]

    def emit(th, data, offset, h, p, a, b):
        raw = data.tobytes()
        digest = hashlib.blake2b
        c = [int.from_bytes(digest(raw[x : y + length], digest_size=8).digest(), "little", signed=True) for x, y in zip(a.tolist(), b.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(th, pa.int64()), pa.array(h, pa.int64()), pa.array(c, pa.int64()), *(pa.array(x - offset, pa.int64()) for x in (p, a, b))], names)

    def run(batches):
        for batch in batches:
            texts, offsets = text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, j in blocks(offsets):
                start, end = int(offsets[i]), int(offsets[j])
                if end - start <= BLOCK:  # else it is one text
                    data = texts[start:end]
                    sizes = np.diff(offsets[i : j + 1])
                    ends = np.repeat(offsets[i + 1 : j + 1] - start, sizes)
                    h, p, a, b = anchors(data, ends, length, gram)
                    if len(h):
                        row = np.searchsorted(offsets[i + 1 : j + 1] - start, a, "right")
                        yield emit(ids[i + row], data, (offsets[i:j] - start)[row], h, p, a, b)
                    continue
                # One long text, in parts that overlap by all but one byte of a window.
                step = BLOCK - length
                for at in range(start, end - length + 1, step):
                    data = texts[at : min(at + step + length - 1, end)]
                    h, p, a, b = anchors(data, np.full(len(data), len(data)), length, gram)
                    if len(h):
                        yield emit(np.full(len(h), ids[i]), data, np.full(len(h), start - at), h, p, a, b)

    return run


_MEMBER = "k bigint, s bigint, h bigint, c bigint, n bigint, off bigint, context binary"
_KINDS = pa.schema([(x, pa.binary() if x == "context" else pa.int64()) for x in ("k", "s", "h", "c", "n", "off", "context")])


def _short(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def _packed(members):
    """Batches of members, of some megabytes each."""
    rows, size = [], 0
    for row in members:
        rows.append(row)
        size += len(row[-1])
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _KINDS)], schema=_KINDS)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _KINDS)], schema=_KINDS)


def _contexts(length: int):
    def members(batches):
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1)):
                data = text.as_py().encode()
                for w in wanted.as_py():
                    yield w["h"], w["c"], w["h"], w["c"], w["n"], w["p"] - w["a"], data[w["a"] : w["b"] + length]

    return lambda batches: _packed(members(batches))


def _stretches(length: int, gram: int, size: int):
    """Deals the windows of a member out to stretches of ``size`` places: only members that agree in all
    bytes that the windows of a stretch share meet again there."""

    def members(batches):
        for batch in batches:
            for h, c, n, off, context in zip(*(batch.column(x).to_pylist() for x in ("h", "c", "n", "off", "context"))):
                low = off - (len(context) - length)
                for first in range(low - low % size, off + 1, size):
                    last = min(first + size - 1, length - gram)
                    a, b = max(low, first), min(off, last)
                    own = context[off - b : off - a + length]
                    place = first.to_bytes(8, "little")
                    key = _short(h.to_bytes(8, "little", signed=True), place, context[off - first : off - last + length])
                    yield key, _short(b.to_bytes(8, "little"), own), h, c, n, b, own

    return lambda batches: _packed(members(batches))


def common(x: bytes, y: bytes, at: int) -> int:
    """Length of the longest common prefix, known to be ``at`` or more."""
    low, high = at, min(len(x), len(y))
    if x[low:high] == y[low:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class BlindTrie:
    """Orders strings that share a long prefix: inner nodes keep only a depth and
    branching bytes; a search goes down blindly and is checked by one comparison."""

    def __init__(self, strings: list[bytes], depth: int):
        self.strings, self.depth = strings, depth
        self.root: list | None = None  # a leaf [-1, indexes] or a node [depth, {byte: child}]

    def symbol(self, s: bytes, at: int) -> int:
        return s[at] if at < len(s) else -1

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [-1, [i]]
            return
        node = self.root
        while node[0] >= 0:
            children = node[1]
            child = children.get(self.symbol(s, node[0]))
            node = child if child is not None else next(iter(children.values()))
        other = self.strings[node[1][0]]
        same = common(s, other, self.depth)
        equal = same == len(s) == len(other)
        parent, node, edge = None, self.root, None
        while 0 <= node[0] < same + equal:
            edge = self.symbol(s, node[0])
            parent, node = node, node[1][edge]
        if equal:
            node[1].append(i)
        elif node[0] == same:
            node[1][self.symbol(s, same)] = [-1, [i]]
        else:
            fork = [same, {self.symbol(s, same): [-1, [i]], self.symbol(other, same): node}]
            if parent is None:
                self.root = fork
            else:
                parent[1][edge] = fork

    def ordered(self, order: list[int], prefix: list[int], first: int) -> None:
        """Appends indexes in order, and each one's common prefix with its predecessor."""
        stack, lcp = [(self.root, first)], first
        while stack:
            node, lcp = stack.pop()
            if node[0] < 0:
                order += node[1]
                prefix += [lcp] + [len(self.strings[node[1][0]])] * (len(node[1]) - 1)
                continue
            keys = sorted(node[1])
            for k in reversed(keys[1:]):
                stack.append((node[1][k], node[0]))
            stack.append((node[1][keys[0]], lcp))


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """(sorted order, common prefix of each string with the one before it)."""
    order: list[int] = []
    prefix: list[int] = []
    # Ternary partitions wait on a stack as (indexes, depth, prefix with what came before).
    stack = [(list(range(len(strings))), 0, 0)]
    while stack:
        group, depth, before = stack.pop()
        if len(group) == 1:
            order.append(group[0])
            prefix.append(before)
            continue
        if depth >= shallow:
            trie = BlindTrie(strings, depth)
            for i in group:
                trie.insert(i)
            trie.ordered(order, prefix, before)
            continue
        symbols = [strings[i][depth] if depth < len(strings[i]) else -1 for i in group]
        pivot = sorted(symbols[:: max(1, len(symbols) // 3)])[min(1, len(symbols) - 1)]
        less = [i for i, s in zip(group, symbols) if s < pivot]
        same = [i for i, s in zip(group, symbols) if s == pivot]
        more = [i for i, s in zip(group, symbols) if s > pivot]
        if more:
            stack.append((more, depth, depth))
        if pivot < 0:  # equal strings that end here
            stack += [([i], depth, depth) for i in same[1:]]
            stack.append(([same[0]], depth, depth if less else before))
        else:
            stack.append((same, depth + 1, depth if less else before))
        if less:
            stack.append((less, depth, before))
    return order, prefix


def repeated(members: list[tuple[int, int, bytes]], length: int = LENGTH, gram: int = GRAM) -> list[list[tuple[int, int]]]:
    """Covered ranges, relative to the gram, for members (count, gram's place in
    the context, context) with one gram and different contexts."""
    m = len(members)
    count = np.array([x[0] for x in members])
    high = np.array([x[1] for x in members])
    low = np.array([off - (len(c) - length) for _, off, c in members])
    if m == 1:
        return [[(-int(high[0]), length - int(low[0]))] if count[0] > 1 else []]
    right_order, right = deep_shallow([c[off + gram :] for _, off, c in members])
    left_order, left = deep_shallow([c[:off][::-1] for _, off, c in members])
    right, left = np.array(right), np.array(left)
    where_right, where_left = np.empty(m, np.int64), np.empty(m, np.int64)
    where_right[right_order], where_left[left_order] = np.arange(m), np.arange(m)
    first, last = int(low.min()), int(high.max())
    hit = np.zeros((last - first + 1, m), bool)
    step = max(1, 2_000_000 // m)
    for at in range(first, last + 1, step):
        d = np.arange(at, min(at + step, last + 1))[:, None]
        runs_right = np.cumsum(right[None, :] < length - gram - d, axis=1)[:, where_right]
        runs_left = np.cumsum(left[None, :] < d, axis=1)[:, where_left]
        able = (low[None, :] <= d) & (d <= high[None, :])
        classes = np.where(able, runs_right * (m + 1) + runs_left, -1 - np.arange(m)[None, :])
        rank = np.argsort(classes, axis=1, kind="stable")
        ordered = np.take_along_axis(classes, rank, 1)
        twin = np.zeros(ordered.shape, bool)
        equal = ordered[:, 1:] == ordered[:, :-1]
        twin[:, 1:] |= equal
        twin[:, :-1] |= equal
        found = np.zeros_like(twin)
        np.put_along_axis(found, rank, twin, 1)
        hit[at - first : at - first + len(d)] = able & (found | (count[None, :] > 1))
    out = []
    for i in range(m):
        edge = np.diff(np.concatenate([[0], hit[:, i].astype(np.int8), [0]]))
        out.append([(-(int(e) - 1 + first), length - (int(s) + first)) for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
    return out


def _sorted_groups(length: int, gram: int):
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def settle(group: dict[tuple[int, int], tuple[int, int, bytes]]):
        # Members whose grams differ only met by a collision of hashes.
        by_gram: dict[bytes, list[tuple[int, int]]] = {}
        for c, (_, off, context) in group.items():
            by_gram.setdefault(context[off : off + gram], []).append(c)
        for own in by_gram.values():
            for c, ranges in zip(own, repeated([group[c] for c in own], length, gram)):
                if ranges:
                    yield *c, ranges

    def run(batches):
        held, group, rows = None, {}, []

        def batch():
            h, c, r = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array([[{"lo": x, "hi": y} for x, y in q] for q in r], kind)], ["h", "c", "ranges"])

        for b in batches:
            for k, h, c, n, off, context in zip(*(b.column(x).to_pylist() for x in ("k", "h", "c", "n", "off", "context"))):
                if k != held:
                    rows += settle(group)
                    held, group = k, {}
                    if len(rows) >= 5000:
                        yield batch()
                        rows = []
                group[h, c] = (n, off, context)
        rows += settle(group)
        yield batch()

    return run


def _settled(members: DataFrame, length: int, gram: int, most: int) -> DataFrame:
    """(h, c, ranges) of written members (k, s, h, c, n, off, context). Groups of up to ``most`` are sorted in
    a task; the windows of larger ones are dealt out to ever shorter stretches, down to single windows,
    and a stretch ends where nobody shares it or all that meet there are alike."""
    ranges, size = [], length - gram + 1
    while True:
        large = materialise(members.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > most).select("k"), "large-groups")
        none = large.isEmpty()
        rest = members if none else members.join(large, "k", "left_anti")
        ranges.append(materialise(rest.repartition("k").sortWithinPartitions("k").mapInArrow(_sorted_groups(length, gram), _RANGES), "ranges"))
        if none:
            break
        size = -(-size // 4)
        dealt = materialise(members.join(large, "k", "left_semi").mapInArrow(_stretches(length, gram, size), _MEMBER), "stretches")
        met = dealt.groupBy("k").agg(F.sum("n").alias("all"), (F.min("s") == F.max("s")).alias("alike")).where(F.col("all") > 1).select("k", "alike")
        met = dealt.join(materialise(met, "met"), "k")
        whole = F.array(F.struct((-F.col("off")).alias("lo"), (F.length("context") - F.col("off")).cast("long").alias("hi")))
        ranges.append(met.where("alike").select("h", "c", whole.alias("ranges")))
        members = materialise(met.where("not alike").drop("alike"), "members")
    return reduce(DataFrame.unionByName, ranges)


def covered_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """(th, ranges array<struct<lo, hi>>) of the texts of ``docs(th, text)`` that
    hold repeated windows; ranges are in bytes, and may overlap."""
    ship(docs.sparkSession)
    found = materialise(docs.mapInArrow(_anchors(length, gram), "th bigint, h bigint, c bigint, p bigint, a bigint, b bigint"), "anchors")
    # Written first, so that the join below is of two plain shuffles and a hot hash can be split.
    twice = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), (F.min("c") != F.max("c")).alias("mixed")).where("n > 1").select("h", "mixed")
    shared = materialise(found.join(materialise(twice, "shared-hashes"), "h"), "shared-anchors")
    # A hash with one context covers it whole; only where contexts differ are they fetched and sorted.
    mixed = shared.where("mixed")
    one_of_each = mixed.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("th", "p", "a", "b")).alias("r"))
    wanted = materialise(one_of_each.groupBy("r.th").agg(F.collect_list(F.struct("h", "c", "n", "r.p", "r.a", "r.b")).alias("wanted")), "wanted-contexts")
    # All share one partitioning; only texts that are asked for are left, and one of equal ones.
    texts = docs.join(wanted.select("th"), "th", "left_semi").dropDuplicates(["th"])
    members = materialise(texts.join(wanted, "th").select("text", "wanted").mapInArrow(_contexts(length), _MEMBER), "contexts")
    ranges = _settled(members, length, gram, most)
    back = mixed.join(ranges, ["h", "c"]).select("th", F.explode("ranges").alias("r"), "p")
    back = back.select("th", (F.col("p") + F.col("r.lo")).alias("lo"), (F.col("p") + F.col("r.hi")).alias("hi"))
    whole = shared.where("not mixed").select("th", F.col("a").alias("lo"), (F.col("b") + length).alias("hi"))
    return back.unionByName(whole).groupBy("th").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _cut(batches):
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    for b in batches:
        size, kept, spans = [], [], []
        for text, ranges in zip(b.column(1), b.column(2).to_pylist()):
            data = (text.as_py() or "").encode()
            runs = merged([(r["lo"], r["hi"]) for r in ranges or []])
            parts, at = [], 0
            for lo, hi in runs:
                parts.append(data[at:lo])
                at = hi
            size.append(len(data))
            kept.append(b"".join([*parts, data[at:]]))
            spans.append([{"lo": lo, "hi": hi} for lo, hi in runs])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], ["key", "n_bytes", "kept", "spans"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document: (key, n_bytes, kept binary, spans array<struct<lo, hi>>)."""
    kind = docs.schema[key].dataType.simpleString()
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("th"), body.alias("text"))
    ranges = materialise(covered_ranges(keyed.select("th", "text"), length, gram), "covered")
    return keyed.join(ranges, "th", "left").select("key", "text", "ranges").mapInArrow(_cut, f"key {kind}, n_bytes bigint, kept binary, spans array<struct<lo:bigint,hi:bigint>>").withColumnRenamed("key", key)
