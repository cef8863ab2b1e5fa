"""Hard-negative mining by a block matrix product in two dimensions (SUMMA).

1. Rows that take part are quantised, sorted by label and key and written once; a row's
   number there is its identity.
2. Anchors and rows are cut into blocks, and each block into chunks of dimensions. Blocks fall
   into the groups of a grid. A block of rows goes to every group of anchors, a block of anchors to
   every group of rows, and those that meet in a cell of the grid and chunk are multiplied.
3. The partial tiles of 64-bit integers are shuffled by (anchor block, row block) and added.
4. A tile gives each anchor's best rows of its own label. Their merged best are the positives;
   a second product then gives, for each anchor and positive, the best rows of another
   label within the window of scores. Tiles whose labels cannot serve are not multiplied: as rows
   are sorted by label, the first product takes the few tiles on the diagonal.

A task holds single blocks and tiles of ``ANCHORS`` times ``ROWS`` scores, whatever the size of
the table or of a label. A label with a third of all rows has as many blocks more.

Defined cases: rows with a null label or vector, or a null or non-finite component, take no
part. Missing dimensions of shorter vectors (empty ones too) count as zero. Quantised
components saturate at 32 bits; a hundred times a score must fit 64. Repeated rows are rows of their own, each an anchor or
positive of its own; equal scores rank by ascending key, null keys last, then in the order of the written rows.
A row without a key is no anchor. Texts play no part; other columns are ignored; empty
tables give an empty result, and so does an anchor without a positive or negative.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.storage import materialise, ship

#: Anchors and rows of a block, dimensions of a chunk, blocks of a side in a cell of the grid.
ANCHORS, ROWS, CHUNK, CELL = 128, 2048, 32, 4
#: Sums of products below this are exact in doubles.
EXACT = 1 << 53


def participants(table: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(uid, key, label, vector array<int>), sorted by label and key; written once."""
    v = F.col(vector)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    cut = lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(2**31 - 1)), F.lit(-(2**31))).cast("int")
    rows = table.select(F.col(key).alias("key"), label.alias("label"), v.alias("v")).where(F.col("label").isNotNull() & F.col("v").isNotNull() & whole)
    rows = rows.select("key", "label", F.transform("v", cut).alias("vector"))
    rows = rows.repartitionByRange("label", "key").sortWithinPartitions("label", "key")
    return materialise(rows.select(F.monotonically_increasing_id().alias("uid"), "*"), "hard-negative-rows")


def _blocks(most: int, chunk: int, names: list[str]):
    """Cuts (uid, key, label, vector, ...) into blocks; each chunk of one is a row (number, least
    and greatest label, chunk, data), the first also lists the other columns' values."""

    def run(batches):
        held, size = [], 0

        def cut():
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            lists = b.column(3)
            sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
            wide = np.zeros((b.num_rows, int(sizes.max())), "<i4")
            wide[np.arange(wide.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
            labels = pc.min_max(b.column(2))
            parts = range(max(1, -(-wide.shape[1] // chunk)))
            n = len(parts)
            data = [np.ascontiguousarray(wide[:, k * chunk : (k + 1) * chunk]).tobytes() for k in parts]
            columns = [pa.array([b.column(0)[0].as_py()] * n, pa.int64()), *(pa.array([labels[x].as_py()] * n, b.column(2).type) for x in ("min", "max"))]
            columns += [pa.array(parts, pa.int32()), pa.array([b.num_rows] * n, pa.int32()), pa.array(data, pa.binary())]
            for c in (0, 1, 2, *range(4, b.num_columns)):
                at = pa.array([0, *[b.num_rows] * n], pa.int32())
                first = pa.ListArray.from_arrays(at, b.column(c))
                columns.append(pc.if_else(pa.array([k == 0 for k in parts]), first, pa.scalar(None, first.type)))
            return pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            at = 0
            while at < b.num_rows:
                held.append(b.slice(at, most - size))
                size, at = size + held[-1].num_rows, at + held[-1].num_rows
                if size == most:
                    yield cut()
                    held, size = [], 0
        if held:
            yield cut()

    return run


def cut_blocks(rows: DataFrame, mark: str, most: int, chunk: int) -> DataFrame:
    """Blocks of ``rows``; all columns begin with ``mark`` but the chunk's number."""
    kinds = dict(rows.dtypes)
    listed = [c for c in rows.columns if c != "vector"]
    names = [f"{mark}", f"{mark}_low", f"{mark}_high", "chunk", f"{mark}_n", f"{mark}_data", *(f"{mark}_{c}" for c in listed)]
    types = ["bigint", kinds["label"], kinds["label"], "int", "int", "binary", *(f"array<{kinds[c]}>" for c in listed)]
    ordered = rows.select("uid", "key", "label", "vector", *[c for c in rows.columns if c not in ("uid", "key", "label", "vector")])
    return ordered.mapInArrow(_blocks(most, chunk, names), ", ".join(f"{n} {t}" for n, t in zip(names, types)))


def _partial_tiles(batches):
    """The product of each pair of chunks, an exact tile of 64-bit integers."""
    for b in batches:
        for r in range(b.num_rows):
            na, nb = b.column("a_n")[r].as_py(), b.column("b_n")[r].as_py()
            x, y = (np.frombuffer(b.column(c)[r].as_buffer(), "<i4").reshape(n, -1) for c, n in (("a_data", na), ("b_data", nb)))
            w = min(x.shape[1], y.shape[1])
            x, y = x[:, :w], y[:, :w]
            top = int(np.abs(x.astype(np.int64)).max(initial=0)) * int(np.abs(y.astype(np.int64)).max(initial=0)) * w
            kind = np.float64 if top < EXACT else np.int64
            tile = (x.astype(kind) @ y.astype(kind).T).astype("<i8")
            names = [n for n in b.schema.names if n not in ("a_data", "b_data", "a_n", "b_n")]
            one = b.slice(r, 1)
            yield pa.RecordBatch.from_arrays([*(one.column(n) for n in names), pa.array([tile.tobytes()], pa.binary())], [*names, "tile"])


def summed_tiles(anchors: DataFrame, rows: DataFrame, grid: tuple[int, int], wanted: Column, reduce, schema: str) -> DataFrame:
    """Applies ``reduce(tile, anchor columns, row columns)`` to every wanted tile of the product
    of two tables of blocks, marked ``a`` and ``b``, over a ``grid`` of (anchor, row) groups."""
    high, wide = grid
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    x = anchors.withColumn("row", F.pmod(F.xxhash64("a"), F.lit(high))).withColumn("column", every(wide))
    y = rows.withColumn("column", F.pmod(F.xxhash64("b"), F.lit(wide))).withColumn("row", every(high))
    met = x.join(y, ["row", "column", "chunk"]).where(wanted)
    lists = [c for c in met.columns if c[:2] in ("a_", "b_") and c[2:] not in ("low", "high", "n", "data")]
    met = met.select("a", "b", "chunk", "a_n", "b_n", "a_data", "b_data", *lists)
    kinds = dict(met.dtypes)
    partial = met.mapInArrow(_partial_tiles, ", ".join(f"{c} {kinds[c]}" for c in ("a", "b", "chunk", *lists)) + ", tile binary")

    def add(table: pa.Table) -> pa.Table:
        first = table.filter(pc.equal(table.column("chunk"), 0)).combine_chunks()
        held = {c: pc.list_flatten(first.column(c)).combine_chunks() for c in lists}
        total = sum(np.frombuffer(t.as_buffer(), "<i8") for t in table.column("tile")).reshape(len(held["a_uid"]), len(held["b_uid"]))
        return reduce(total, {c[2:]: v for c, v in held.items() if c[:2] == "a_"}, {c[2:]: v for c, v in held.items() if c[:2] == "b_"})

    return partial.groupBy("a", "b").applyInArrow(add, schema)


def _best_of_label(most: int, names: list[str]):
    """(anchor, row, score): an anchor's best rows of its own label."""

    def reduce(tile, a, b):
        by_key = pc.array_sort_indices(b["key"]).to_numpy()
        tile = tile[:, by_key]
        labels, own = b["label"].to_numpy(zero_copy_only=False)[by_key], a["label"].to_numpy(zero_copy_only=False)
        uids, self_ = b["uid"].to_numpy()[by_key], a["uid"].to_numpy()
        row, column = [], []
        for r in range(len(tile)):
            fit = np.flatnonzero((labels == own[r]) & (uids != self_[r]))
            best = fit[np.argsort(-tile[r, fit], kind="stable")[:most]]
            row.append(np.full(len(best), r))
            column.append(best)
        row, column = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (row, column))
        return pa.table([pa.array(self_[row]), pa.array(uids[column]), b["key"].take(pa.array(by_key[column])), pa.array(tile[row, column])], names=names)

    return reduce


def _best_in_windows(most: int, low: int, high: int, names: list[str]):
    """(anchor, its key, positive, its key and score, row's key, number and score): for each of an
    anchor's positives the best rows of other labels, ``low`` to ``high`` hundredths of its score."""

    def reduce(tile, a, b):
        by_key = pc.array_sort_indices(b["key"]).to_numpy()
        tile = tile[:, by_key]
        labels, own = b["label"].to_numpy(zero_copy_only=False)[by_key], a["label"].to_numpy(zero_copy_only=False)
        ends = a["positives"].offsets.to_numpy()
        positives = a["positives"].flatten()
        scores = positives.field("score").to_numpy()
        row, positive, column = [], [], []
        for r in range(len(tile)):
            fit = np.flatnonzero(labels != own[r])
            order = fit[np.argsort(-tile[r, fit], kind="stable")]
            falling = -100 * tile[r, order]
            for p in range(ends[r] - ends[0], ends[r + 1] - ends[0]):
                first, end = np.searchsorted(falling, -high * scores[p], "left"), np.searchsorted(falling, -low * scores[p], "right")
                best = order[first : min(first + most, end)]
                row.append(np.full(len(best), r))
                positive.append(np.full(len(best), p))
                column.append(best)
        row, positive, column = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (row, positive, column))
        at, of, to = pa.array(row), pa.array(positive), pa.array(by_key[column])
        columns = [a["uid"].take(at), a["key"].take(at), *(positives.field(f).take(of) for f in ("uid", "key", "score")), b["key"].take(to), b["uid"].take(to), pa.array(tile[row, column])]
        return pa.table(columns, names=names)

    return reduce


def hard_negatives(
    table: DataFrame,
    anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: Column | str = "label",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    chunk: int = CHUNK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(``scale`` * x), scores are inner products. Anchors are the rows that
    ``anchor``, a condition on the column ``key``, picks. An anchor's positives are its best other
    rows of the same label; each has as its negatives the best rows of other labels whose
    scores are between ``low`` and ``high`` hundredths of the positive's."""
    ship(table.sparkSession)
    rows = participants(table, key, vector, F.col(label) if isinstance(label, str) else label, scale)
    kind = dict(rows.dtypes)["key"]
    asked = rows.where(anchor)
    # As many tasks as the anchors fill; they stay in the order of the written rows.
    n = asked.count()
    tasks, grid = max(1, -(-n // (8 * ANCHORS))), (max(1, -(-n // (CELL * ANCHORS))), max(1, -(-rows.count() // (CELL * ROWS))))
    blocks = cut_blocks(rows, "b", ROWS, chunk)

    meet = (F.col("a_low") <= F.col("b_high")) & (F.col("b_low") <= F.col("a_high"))
    names = ["anchor", "uid", "key", "score"]
    near = summed_tiles(cut_blocks(asked.coalesce(tasks), "a", ANCHORS, chunk), blocks, grid, meet, _best_of_label(positives, names), f"anchor bigint, uid bigint, key {kind}, score bigint")
    best = Window.partitionBy("anchor").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last(), "uid")
    chosen = near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives)
    # At most ``positives`` entries a list.
    listed = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("n", "uid", "key", "score"))).alias("positives"))
    paired = materialise(asked.join(listed.withColumnRenamed("anchor", "uid"), "uid"), "hard-negative-anchors")

    differ = ~((F.col("a_low") == F.col("a_high")) & (F.col("b_low") == F.col("b_high")) & (F.col("a_low") == F.col("b_low")))
    names = ["anchor", "anchor_id", "positive", "positive_id", "positive_score", "negative_id", "negative", "negative_score"]
    schema = f"anchor bigint, anchor_id {kind}, positive bigint, positive_id {kind}, positive_score bigint, negative_id {kind}, negative bigint, negative_score bigint"
    far = summed_tiles(cut_blocks(paired.coalesce(tasks), "a", ANCHORS, chunk), blocks, grid, differ, _best_in_windows(negatives, low, high, names), schema)
    best = Window.partitionBy("anchor", "positive").orderBy(F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last(), "negative")
    ranked = far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
