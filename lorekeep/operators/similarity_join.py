"""Similarity joins of vectors by cosine: a blocked product of a table with itself.

Rows are sorted so that similar ones stand together, written once and cut into
blocks of ``ROWS``. A task multiplies one block with another, so it never holds more than two
blocks and their tile, however large the table, a label or a cluster.

* **Exact.** Every two blocks meet, unless their centres are so far apart that no two rows
  can reach the threshold (the angles' triangle inequality). Blocks fall into at most ``SIDE``
  groups, and two groups meet in a task: a block is sent ``SIDE`` + 1 times, however large the table.
* **By random projection.** Each row has ``tables`` signatures of ``bits`` signs. Only
  blocks that share a bucket meet, and rows of other buckets in them are passed over. A link
  counts in the first table that finds it. How many tables are needed follows from the threshold
  and the recall that is asked for; ``measured_recall`` measures it.

A bucket that holds a third of all rows is as many blocks as it fills, and these
meet in pairs, spread over tasks.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.vectors import unit, usable
from lorekeep.storage import materialise, ship

#: Rows of a block, least blocks of a group, most groups, pivots that order the rows, most tables
#: (each is a copy of all vectors on disk).
ROWS, CELL, SIDE, PIVOTS, MOST_TABLES = 1024, 4, 8, 32, 16


def _flat(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(rows, -1)


def _numbered(vectors: DataFrame, id_: str, vector: str, group: str | None) -> DataFrame:
    """(id, group, vector) of the usable rows of the longest size."""
    good = vectors.where(usable(F.col(vector))).select(F.col(id_).alias("id"), F.col(group or id_).alias("grp"), F.col(vector).alias("vector"))
    return good.where(F.size("vector") == (good.agg(F.max(F.size("vector"))).first()[0] or 0))


def _keyed(work, extra: list[str]):
    """Adds sort keys that ``work(unit vectors)`` gives to batches of rows."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                keys = work(unit(_flat(b.column("vector"), b.num_rows)))
                yield pa.RecordBatch.from_arrays([*b.columns, *keys], [*b.schema.names, *extra])

    return run


def _cut(rows: int, names: list[str]):
    """Blocks of sorted (uid, id, grp, vector, key, signature): first uid, lists, vectors as given,
    centre and radius, least and greatest key. A block stays within one ``table`` (or cell)."""

    def run(batches):
        held, size, table = [], 0, None

        def block():
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            x = unit(_flat(b.column("vector"), b.num_rows))
            centre = unit(x.mean(0, keepdims=True))[0]
            radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
            keys = b.column("key")
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c))
            columns = [pa.array([b.column("uid")[0].as_py()]), pa.array([table], pa.int32()), one("id"), one("grp"), one("uid"), one("key"), one("signature")]
            given = b.column("vector").flatten().to_numpy(zero_copy_only=False)
            columns += [pa.array([given.tobytes()], pa.binary()), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius]), keys[:1], keys[-1:]]
            return pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            tables = b.column("table").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(tables)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                while lo < hi:
                    if held and (size == rows or tables[lo] != table):
                        yield block()
                        held, size = [], 0
                    table = int(tables[lo])
                    held.append(b.slice(lo, min(hi - lo, rows - size)))
                    size, lo = size + held[-1].num_rows, lo + held[-1].num_rows
        if held:
            yield block()

    return run


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of written rows (uid, id, grp, vector, table, key, signature)."""
    kinds = dict(rows.dtypes)
    schema = f"block bigint, tbl int, ids array<{kinds['id']}>, groups array<{kinds['grp']}>, uids array<bigint>, keys array<bigint>, signatures array<array<int>>, data binary, centre array<double>, radius double, low bigint, high bigint"
    return rows.mapInArrow(_cut(size, [f.split()[0] for f in schema.split(", ")]), schema)


def _sorted(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows in the order of their keys with a number each, written once."""
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialise(ordered.select(F.monotonically_increasing_id().alias("uid"), "*"), "similarity-rows")


def exact_blocks(vectors: DataFrame, id_: str, vector: str, group: str | None = None, rows: int = ROWS, pivots: int = PIVOTS) -> DataFrame:
    """Blocks of rows that stand together by their nearest pivot; the bounded pivots are the
    vectors of the smallest hashes."""
    spark = vectors.sparkSession
    ship(spark)
    good = _numbered(vectors, id_, vector, group)
    table = good.orderBy(F.xxhash64("id"), "id").limit(pivots).select("vector").toArrow().combine_chunks()
    points = unit(_flat(table.column(0).chunk(0), table.num_rows)) if table.num_rows else np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(points)

    def nearest(x):
        near = x @ shared.value.T
        # Rows of a cell from its pivot outwards, so that blocks are shells of it.
        cell = near.argmax(1)
        return [pa.array(cell.astype(np.int64)), pa.array(-near[np.arange(len(x)), cell])]

    kinds = dict(good.dtypes)
    keyed = good.mapInArrow(_keyed(nearest, ["key", "shell"]), f"id {kinds['id']}, grp {kinds['grp']}, vector {kinds['vector']}, key bigint, shell double")
    marked = keyed.select("id", "grp", "vector", F.col("key").cast("int").alias("table"), "key", F.lit(None).cast("array<int>").alias("signature"), "shell")
    return materialise(_blocks(_sorted(marked, "key", "shell"), rows), "similarity-blocks")


def reaching(threshold: float) -> Column:
    """Whether two blocks, marked a and b, can hold rows whose cosine reaches the threshold."""
    dot = F.aggregate(F.zip_with("a.centre", "b.centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    angle = F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0)))
    return angle <= math.acos(max(-1.0, min(1.0, threshold - 1e-6))) + F.col("a.radius") + F.col("b.radius") + 1e-7


def exact_pairs(blocks: DataFrame, threshold: float) -> DataFrame:
    """(a, b): every two blocks, each with itself too, that can hold a link."""
    side = max(1, min(SIDE, -(-blocks.count() // CELL)))
    own, last = F.pmod(F.xxhash64("block"), F.lit(side)), F.lit(side - 1).cast("long")
    held = blocks.select(F.struct("block", "tbl", "ids", "groups", "uids", "data", "centre", "radius").alias("x"), own.alias("own"))
    # Cells on one side of the diagonal: a group is the row of those from its own on, the column of those up to it.
    a = held.select(F.col("x").alias("a"), F.col("own").alias("row"), F.explode(F.sequence("own", last)).alias("column"))
    b = held.select(F.col("x").alias("b"), F.col("own").alias("column"), F.explode(F.sequence(F.lit(0).cast("long"), "own")).alias("row"))
    a, b = (x.repartition(side * (side + 1), "row", "column") for x in (a, b))
    once = (F.col("row") < F.col("column")) | (F.col("a.block") <= F.col("b.block"))
    return a.join(b, ["row", "column"]).where(once & reaching(threshold)).select("a", "b")


class _Block:
    def __init__(self, s: pa.StructScalar):
        self.block, self.table = s["block"].as_py(), s["tbl"].as_py()
        self.uids = s["uids"].values.to_numpy()
        self.ids, self.groups = s["ids"].values, s["groups"].values
        self.keys, self.signatures = (s[n].values if n in s else None for n in ("keys", "signatures"))
        data, dims = s["data"].as_buffer(), len(s["centre"].values)
        kind = np.float64 if len(data) == 8 * dims * len(self.uids) else np.float32
        self.x = unit(np.frombuffer(data, kind).astype(np.float64).reshape(len(self.uids), -1))


def _over_pairs(work, names: list[str]):
    """``work(block, block, same)`` of each pair."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = _Block(batch.column(0)[r]), _Block(batch.column(1)[r])
                for columns in work(a, b, a.block == b.block):
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _link_counts(threshold: float, buckets: bool):
    def work(a: _Block, b: _Block, same: bool):
        linked = np.round(a.x @ b.x.T, 6) >= threshold
        if same:
            np.fill_diagonal(linked, False)
        if buckets:
            linked &= a.keys.to_numpy()[:, None] == b.keys.to_numpy()
            at, to = np.nonzero(linked)
            if a.table and len(at):  # an earlier table has found what shares its bucket
                p, q = (np.asarray(s.flatten().to_numpy(), np.int32).reshape(len(s), -1)[:, : a.table] for s in (a.signatures, b.signatures))
                old = (p[at] == q[to]).any(1)
                linked[at[old], to[old]] = False
        for own, other, hits in ((a, b, linked),) if same else ((a, b, linked), (b, a, linked.T)):
            n = hits.sum(1)
            some = np.flatnonzero(n > 0) if not same else np.arange(len(n))
            # The least partner: the first linked column in the order of ids.
            order = pc.array_sort_indices(other.ids).to_numpy()
            least = order[hits[some][:, order].argmax(1)] if len(order) else some
            found = n[some] > 0
            partner = pc.if_else(pa.array(found), other.ids.take(pa.array(least)), pa.scalar(None, other.ids.type))
            yield [pa.array(own.uids[some]), own.ids.take(pa.array(some)), pa.array(n[some], pa.int64()), partner]

    return work


def _counted(pairs: DataFrame, threshold: float, buckets: bool) -> DataFrame:
    kind = pairs.schema["a"].dataType["ids"].dataType.elementType.simpleString()
    found = pairs.mapInArrow(_over_pairs(_link_counts(threshold, buckets), ["uid", "id", "links", "least"]), f"uid bigint, id {kind}, links bigint, least {kind}")
    return found.groupBy("uid", "id").agg(F.sum("links").alias("links"), F.least("id", F.min("least")).alias("least")).drop("uid")


def similarity_links(vectors: DataFrame, id_: str, vector: str, threshold: float, rows: int = ROWS) -> DataFrame:
    """(id, links, least) of each usable row: how many other rows have a cosine of
    ``threshold`` or more (rounded to 6 places), and the least id among those and its own. Exact.
    Vectors of another size than the longest are left out; repeated rows are rows of their own."""
    return _counted(exact_pairs(exact_blocks(vectors, id_, vector, rows=rows), threshold), threshold, False)


def _totals(thresholds: list[float]):
    def work(a: _Block, b: _Block, same: bool):
        tile = np.round(a.x @ b.x.T, 6)
        if same:
            np.fill_diagonal(tile, -np.inf)
        yield [pa.array(thresholds, pa.float64()), pa.array([int((tile >= t).sum()) * (1 if same else 2) for t in thresholds], pa.int64())]

    return work


def link_totals(vectors: DataFrame, id_: str, vector: str, thresholds: list[float], rows: int = ROWS) -> DataFrame:
    """(threshold, links): the sums of ``similarity_links`` at several thresholds, by one product of the
    table with itself. Exact."""
    pairs = exact_pairs(exact_blocks(vectors, id_, vector, rows=rows), min(thresholds))
    none = vectors.sparkSession.createDataFrame([(float(t), 0) for t in thresholds], "threshold double, links bigint")
    found = pairs.mapInArrow(_over_pairs(_totals([float(t) for t in thresholds]), ["threshold", "links"]), "threshold double, links bigint")
    return found.unionByName(none).groupBy("threshold").agg(F.sum("links").alias("links"))


def _best_of_groups(threshold: float):
    def work(a: _Block, b: _Block, same: bool):
        tile = np.round(a.x @ b.x.T, 6)
        coded = [x.groups.dictionary_encode(null_encoding="encode") for x in (a, b)]
        for axis, c in enumerate(coded):
            at = c.indices.to_numpy()
            order = np.argsort(at, kind="stable")
            tile = np.maximum.reduceat(np.take(tile, order, axis), np.flatnonzero(np.diff(at[order], prepend=-1)), axis)
        r, q = np.nonzero(tile >= threshold)
        yield [coded[0].dictionary.take(pa.array(r)), coded[1].dictionary.take(pa.array(q)), pa.array(tile[r, q])]

    return work


def similar_groups(vectors: DataFrame, id_: str, vector: str, group: str, threshold: float, rows: int = ROWS) -> DataFrame:
    """(a, b, score), a < b: two groups of rows whose best cosine (rounded to 6 places) reaches
    the threshold, with it. Exact. Rows without a group take no part."""
    pairs = exact_pairs(exact_blocks(vectors.where(F.col(group).isNotNull()), id_, vector, group, rows), threshold)
    kind = pairs.schema["a"].dataType["groups"].dataType.elementType.simpleString()
    found = pairs.mapInArrow(_over_pairs(_best_of_groups(threshold), ["x", "y", "score"]), f"x {kind}, y {kind}, score double")
    return found.where("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("score").alias("score"))


def projections(threshold: float, recall: float) -> tuple[int, int]:
    """(bits, tables): the signatures with the least work that find a link at the threshold with
    the probability ``recall``. Two vectors agree in a sign with probability 1 - angle / pi."""
    p = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    choices = []
    for bits in range(1, 25):
        hit = min(p**bits, 1 - 1e-12)
        tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))
        if tables <= MOST_TABLES:
            choices.append((tables / 2**bits, bits, tables))
    _, bits, tables = min(choices) if choices else (0, 1, MOST_TABLES)
    return bits, tables


def projected_links(vectors: DataFrame, id_: str, vector: str, threshold: float, recall: float = 0.95, rows: int = ROWS, seed: int = 1) -> DataFrame:
    """As ``similarity_links``, but of the links that random projections find: each with a
    probability of ``recall`` or more, every one found is verified. Rows without one stay."""
    spark = vectors.sparkSession
    ship(spark)
    bits, tables = projections(threshold, recall)
    good = _numbered(vectors, id_, vector, None)
    dims = good.agg(F.max(F.size("vector"))).first()[0] or 1
    planes = spark.sparkContext.broadcast(np.random.default_rng(seed).standard_normal((dims, tables * bits)))

    def signed(x):
        signs = (x @ planes.value > 0).reshape(len(x), tables, bits)
        codes = (signs * (1 << np.arange(bits))).sum(2).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32)), pa.array(codes.ravel()))]

    kinds = dict(good.dtypes)
    numbered = materialise(good.select(F.monotonically_increasing_id().alias("uid"), "*"), "projected-rows")
    keyed = numbered.mapInArrow(_keyed(signed, ["signature"]), f"uid bigint, id {kinds['id']}, grp {kinds['grp']}, vector {kinds['vector']}, signature array<int>")
    dealt = keyed.select("uid", "id", "grp", "vector", "signature", F.posexplode("signature").alias("table", "key")).withColumn("key", F.col("key").cast("long"))
    ordered = dealt.repartitionByRange("table", "key", "uid").sortWithinPartitions("table", "key", "uid")
    # A row is in each table, so a block is named by its table and first row.
    blocks = materialise(_blocks(ordered.select("uid", "id", "grp", "vector", "table", "key", "signature"), rows), "projected-blocks")
    x = blocks.select(F.struct("*").alias("a"), "tbl", F.col("high").alias("shared"))
    y = blocks.select(F.struct("*").alias("b"), "tbl", F.col("low").alias("shared"))
    # Of two blocks in order, the former's last bucket is the latter's first, or they share none.
    after = lambda m: F.struct(f"{m}.low", f"{m}.high", f"{m}.block")
    others = x.join(y, ["tbl", "shared"]).where(F.col("a.block") != F.col("b.block")).where((F.col("a.low") < F.col("b.low")) | ((F.col("a.low") == F.col("b.low")) & (after("a") < after("b")))).select("a", "b")
    own = blocks.select(F.struct("*").alias("a"), F.struct("*").alias("b"))
    return _counted(own.unionByName(others), threshold, True)


def measured_recalls(vectors: DataFrame, id_: str, vector: str, thresholds: list[float], recall: float = 0.95, rows: int = ROWS) -> DataFrame:
    """(threshold, links, found, recall): links of the exact join and those that projections find."""
    found = [
        projected_links(vectors, id_, vector, t, recall, rows).agg(F.coalesce(F.sum("links"), F.lit(0)).alias("found")).select(F.lit(float(t)).alias("threshold"), "found")
        for t in thresholds
    ]
    both = link_totals(vectors, id_, vector, thresholds, rows).join(reduce(DataFrame.unionByName, found), "threshold")
    return both.withColumn("recall", F.when(F.col("links") == 0, 1.0).otherwise(F.col("found") / F.col("links")))


def measured_recall(vectors: DataFrame, id_: str, vector: str, threshold: float, recall: float = 0.95, rows: int = ROWS) -> DataFrame:
    """One row (links, found, recall) of ``measured_recalls`` at one threshold."""
    return measured_recalls(vectors, id_, vector, [threshold], recall, rows).drop("threshold")
