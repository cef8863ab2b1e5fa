"""Near-duplicate detection with HyperMinHash sketches.

A document's set holds its distinct word shingles. Its sketch has 256 registers:
the top bits of a shingle's hash choose the register, and of the least remaining
bits the register stores the count of leading zeros and the next ten mantissa
bits. Empty registers borrow from a pseudo-random full one (optimal
densification), so short documents band like long ones.

1. One pass writes (key, size, node, registers); equal sets share a node, so
   exact copies collapse before anything is compared.
2. Bands of compressed registers bucket the nodes; a band has as many registers
   as the threshold allows (see ``band_rows``). In each bucket every
   node is paired with the bucket's least node only (map-side minima, then a
   join that adaptive execution can split), never with all others.
3. Register agreement gives a Jaccard estimate corrected for chance collisions;
   pairs more than four standard errors below the threshold are dropped.
4. The rest are verified on full sets: first each node's best pair, then those
   pairs that still join different components.
5. Buckets that still hold several components are settled exactly, so a link
   between two nodes that both miss the bucket's least node is found too. Nodes
   that such buckets connect form a group; a task holds a bounded block of it, or
   two, counts shared elements through an inverted index, and returns only
   links that join components, never pairs.

A pair at the threshold shares no band with a probability below 5e-6 (36 bands
of 7 registers at 0.85, 42 of 6 at 0.8), a closer one far less. Sets are equal when 128 bits of a cryptographic digest are; a node is the
number that a digest has in a written table. Shingles are compared by 64-bit hashes under a
key that is drawn anew for every call (or that the session names in ``spark.lorekeep.hash.key``),
so nobody can write texts whose different words share a hash; by chance two do with a probability of 2 ** -64.

Defined cases: null text, or text without words, has the empty set, links with
nothing and stays; fewer words than a shingle count as one shingle; a component's
id is its least key, nulls last; rows repeated with one key and text have equal
verdicts, rows of one key (or none) and different texts their own;
``keep_representatives`` keeps one of repeated rows; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import secrets
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.components import connected_components
from lorekeep.llm.hashing import mixed, shingle_hashes, word_hashes
from lorekeep.storage import materialise, ship

REGISTERS, MANTISSA = 256, 10
#: Highest probability that two sets just at the threshold share no band.
MISSED = 5e-6
#: Set elements (8 bytes each) of a block that one task holds.
BLOCK_ELEMENTS = 4_000_000


def band_rows(similarity: float) -> int:
    """Registers a band: as many as keep the missed share low."""
    return max([r for r in range(1, 17) if (1 - similarity**r) ** (REGISTERS // r) <= MISSED], default=1)


def _borrowing() -> np.ndarray:
    order = mixed(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(77)).reshape(REGISTERS, REGISTERS)
    return np.argsort(order, axis=1)


BORROW = _borrowing()


def registers(hashes: np.ndarray) -> np.ndarray:
    """Sketch of a sorted, distinct, non-empty array of hashes, 16 bits a register."""
    bucket = (hashes >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    rest = ((hashes[first] >> np.uint64(4)) & np.uint64((1 << 52) - 1)).astype(np.float64)
    fraction, exponent = np.frexp(rest)
    value = ((52 - exponent) << MANTISSA) + np.where(rest > 0, (fraction * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
    full, out = np.zeros(REGISTERS, bool), np.zeros(REGISTERS, np.int64)
    full[bucket[first]] = True
    out[bucket[first]] = value
    empty = np.flatnonzero(~full)
    if len(empty):
        donors = BORROW[empty]
        out[empty] = out[donors[np.arange(len(empty)), full[donors].argmax(1)]]
    return out.astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers for sets of n and m elements, less
    the collisions that chance would give (Yu and Weber, 2017)."""
    agree = (a == b).mean(1)
    ratio = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    chance = 0.169919487159739 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return (agree - chance) / (1 - chance)


def shingle_sets(column: pa.Array, size: int, secret: bytes = b"shingles"):
    """The sorted distinct shingle hashes of each row."""
    for _, hashes, counts in word_hashes(column, lower=True, key=secret):
        at = 0
        for n in counts.tolist():
            yield np.unique(shingle_hashes(hashes[at : at + n], size))
            at += n


def digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sketches(size: int, secret: bytes):
    def run(batches):
        for b in batches:
            n, digests, regs = [], [], []
            for s in shingle_sets(b.column(1), size, secret):
                n.append(len(s))
                digests.append(digest(s))
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())], ["key", "th", "n", "digest", "regs"])

    return run


def _sets(size: int, secret: bytes):
    def run(batches):
        for b in batches:
            sets = list(shingle_sets(b.column(1), size, secret))
            yield pa.RecordBatch.from_arrays([pa.array(list(map(digest, sets)), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "members"])

    return run


def _estimated(least: float):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u2").reshape(-1, REGISTERS) for k in ("x", "y"))
            e = estimate(x, y, b.column("n").to_numpy(), b.column("m").to_numpy())
            # Sizes alone bound the similarity too.
            ok = pa.array(e >= least)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok), pa.array(e[e >= least], pa.float64())], ["a", "b", "estimate"])

    return run


def _verified(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y")):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                both = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            ok = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], ["a", "b"])

    return run


def joining(nodes: list[int], component: list[int], sets: list[np.ndarray], second: list[bool], percent: int) -> list[tuple[int, int]]:
    """Links that join components of a group: at most one fewer than those. With
    ``second`` not constant, only links between the two blocks are looked for."""
    n = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    values, codes, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(codes, kind="stable")
    posting, starts = owner[order], np.concatenate([[0], np.cumsum(often)])
    offsets = np.concatenate([[0], np.cumsum(n)])
    parent = {c: c for c in component}

    def root(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    sizes: dict[int, int] = {}
    for c in component:
        sizes[c] = sizes.get(c, 0) + 1
    largest = max(sizes, key=lambda c: (sizes[c], c))
    blocks, two = np.array(second), len(set(second)) > 1
    links = []
    for i in range(len(sets)):
        if component[i] == largest and not two:
            continue  # of two components one is not the largest
        own = codes[offsets[i] : offsets[i + 1]]
        own = own[often[own] > 1]
        if 100 * len(own) < percent * n[i]:
            continue  # what no other member has bounds every similarity
        shared = np.zeros(len(sets), np.int64)
        length, at = often[own], 0
        while at < len(own):  # a bounded stretch of postings at a time
            end = max(at + 1, at + int(np.searchsorted(np.cumsum(length[at:]), 2_000_000)))
            k = length[at:end]
            places = np.repeat(starts[own[at:end]] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
            shared += np.bincount(posting[places], minlength=len(sets))
            at = end
        linked = 100 * shared >= percent * (n[i] + n - shared)
        if two:
            linked &= blocks != blocks[i]
        for j in np.flatnonzero(linked).tolist():
            p, q = root(component[i]), root(component[j])
            if p != q:
                parent[max(p, q)] = min(p, q)
                links.append((nodes[i], nodes[j]))
    return links


def _settled(percent: int):
    """Links of groups; rows come sorted by (group, i, j), the blocks compared."""

    def run(batches):
        held, rows = None, []
        out: list[tuple[int, int]] = []

        def settle():
            if len({r[1] for r in rows}) > 1:
                nodes, component, second, sets = zip(*rows)
                out.extend(joining(list(nodes), list(component), list(sets), list(second), percent))

        for b in batches:
            for group, i, j, block, node, component, members in zip(*(b.column(k).to_pylist() for k in range(7))):
                if (group, i, j) != held:
                    settle()
                    held, rows = (group, i, j), []
                rows.append((node, component, block == j and i != j, np.frombuffer(members, np.uint64)))
        settle()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], []))], ["a", "b"])

    return run


def classes(docs: DataFrame, size: int, percent: int, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(sketches(key, th, n, digest), members(digest, component) of sets with a link,
    the component by the digest of its least node); ``th`` is a hash of the text,
    which tells rows of one key apart."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    secret = (docs.sparkSession.conf.get("spark.lorekeep.hash.key", None) or secrets.token_hex(32)).encode()[:64]
    sketches = materialise(docs.select(key, text, F.xxhash64(text).alias("th")).mapInArrow(_sketches(size, secret), f"key {kind}, th bigint, n bigint, digest binary, regs binary"), "sketches")
    equal = sketches.where("n > 0").groupBy("digest").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    nodes = materialise(equal.withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = band_rows(percent / 100)
    width = 2 * rows
    bands = nodes.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // rows - 1)), lambda i: F.xxhash64(F.substring("regs", i * width + 1, F.lit(width)), i))).alias("band"))
    shared = bands.groupBy("band").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").select("band", "least")
    bucketed = materialise(bands.join(shared, "band").select("band", "node", "least"), "buckets")
    least = percent / 100 - 4 * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5

    def estimated(pairs: DataFrame) -> DataFrame:
        a = nodes.select(F.col("node").alias("a"), F.col("regs").alias("x"), "n")
        b = nodes.select(F.col("node").alias("b"), F.col("regs").alias("y"), F.col("n").alias("m"))
        sized = pairs.join(a, "a").join(b, "b").where(F.least("n", "m") * 100 >= percent * F.greatest("n", "m"))
        return materialise(sized.mapInArrow(_estimated(least), "a bigint, b bigint, estimate double"), "estimates")

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        a, b = sets.select(F.col("node").alias("a"), F.col("members").alias("x")), sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
        return materialise(pairs.select("a", "b").join(a, "a").join(b, "b").mapInArrow(_verified(percent), "a bigint, b bigint"), "links")

    def full_sets(of: DataFrame) -> DataFrame:
        """Sets of the given nodes, from one document of each."""
        wanted = materialise(of.distinct().join(nodes.select("node", "key", "digest"), "node"), "wanted")
        keys = wanted.select(F.col("key").alias("wanted_key")).distinct()
        texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        rows = texts.join(keys, texts["key"].eqNullSafe(keys["wanted_key"]), "left_semi").select("key", "text").mapInArrow(_sets(size, secret), "digest binary, members binary")
        return materialise(rows.join(wanted.select("digest", "node"), "digest").groupBy("node").agg(F.first("members").alias("members")), "sets")

    def crossing(pairs: DataFrame, members: DataFrame) -> DataFrame:
        """Pairs whose ends are not yet in one component."""
        ends = pairs
        for end in ("a", "b"):
            ends = ends.join(members.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
        return ends.where("ca <> cb").select("a", "b")

    found = estimated(bucketed.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct())
    sets = full_sets(found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))))
    best = found.groupBy("b").agg(F.max_by("a", F.struct("estimate", "a")).alias("a")).select("a", "b")
    links = [verified(best, sets)]
    members = materialise(connected_components(links[0]), "members")
    rest = crossing(found.join(best, ["a", "b"], "left_anti"), members)
    links.append(verified(rest, sets))
    members = materialise(connected_components(reduce(DataFrame.unionByName, links)), "members")

    labelled = bucketed.select("band", "node").join(members, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    mixed_up = labelled.groupBy("band").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("band")
    unsettled = materialise(labelled.join(mixed_up, "band", "left_semi"), "unsettled")
    if unsettled.limit(1).count():
        least_of = unsettled.groupBy("band").agg(F.min("node").alias("a"))
        groups = connected_components(unsettled.join(least_of, "band").select("a", F.col("node").alias("b")), "groups")
        own = unsettled.select("node", "component").distinct().join(groups.withColumnRenamed("component", "group"), "node")
        own = own.join(nodes.select("node", "n"), "node")
        # A group of many elements is dealt into blocks, and each two blocks meet in a task.
        blocks = own.groupBy("group").agg(F.ceil(F.sum("n") / BLOCK_ELEMENTS).cast("int").alias("blocks"))
        dealt = own.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        met = dealt.select("group", "node", "component", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        tasks = met.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component")
        loaded = tasks.join(full_sets(own.select("node")), "node").select("group", "i", "j", "block", "node", "component", "members")
        links.append(materialise(loaded.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "node").mapInArrow(_settled(percent), "a bigint, b bigint"), "links"))
        members = materialise(connected_components(reduce(DataFrame.unionByName, links)), "members")
    names = nodes.select("node", "digest")
    of_component = names.select(F.col("node").alias("component"), F.col("digest").alias("first"))
    return sketches.select("key", "th", "n", "digest"), members.join(names, "node").join(of_component, "component").select("digest", F.col("first").alias("component"))


def decisions(docs: DataFrame, size: int, percent: int, text: str, key: str) -> DataFrame:
    """One row per document: (key, th, n, component_id, kept). Of a component the
    rows of one key and text are kept, those of the least key, nulls last."""
    sketches, members = classes(docs, size, percent, text, key)
    labelled = sketches.join(members, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    row = F.struct(F.col("key").isNull().alias("null"), "key", "digest", "th")
    first = labelled.where("digest is not null").groupBy("component").agg(F.min(row).alias("first"))
    linked = labelled.where("digest is not null").join(first, "component").select("key", "th", "n", F.col("first.key").alias("component_id"), (row == F.col("first")).alias("kept"))
    alone = labelled.where("digest is null").select("key", "th", "n", F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: (key, n_shingles, component_id, kept)."""
    return decisions(docs, size, percent, text, key).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", "kept")


def keep_representatives(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component, decided by
    key and text, and every row whose set is empty."""
    decided = materialise(decisions(docs, size, percent, text, key), "decisions")

    def of(rows: DataFrame, wanted: DataFrame, how: str) -> DataFrame:
        wanted = wanted.select("key", "th").distinct()
        return rows.join(wanted, rows[key].eqNullSafe(wanted["key"]) & (F.xxhash64(rows[text]) == wanted["th"]), how)

    stay = of(docs, decided.where("not kept"), "left_anti")
    repeated = materialise(decided.where("kept and n > 0").groupBy("key", "th").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "repeated")
    if not repeated.limit(1).count():
        return stay
    # Rows repeated with one key and text: one of them stays.
    return of(stay, repeated, "left_anti").unionByName(of(stay, repeated, "left_semi").dropDuplicates([key, text]))
