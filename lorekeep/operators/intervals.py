"""Range sets by key: containment and distance, without pairing everything.

A range of integers is the union of at most two cells of each power of two, and a point lies
in one cell of each. So which points lie in which ranges is an equi-join on cells, whatever
the ranges' lengths: a range of n lines has about 2 log2(n) rows. Two ranges overlap when one's
start lies in the other. The nearest range is looked for among the few of a small group, else
comes from one ordered sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.storage import dealt, materialise

#: Parents of a key that each of its children is compared with one by one.
FEW = 64


def _levels(ranges: DataFrame, start: str, end: str) -> int:
    """The greatest power of two that a cell of these ranges can have."""
    longest = ranges.agg(F.max(F.col(end) - F.col(start) + 1)).first()[0] or 1
    return max(1, longest).bit_length() - 1


def _tiles(start: Column, end: Column, levels: int, made) -> Column:
    start, end, found = start.cast("long"), end.cast("long") + 1, []
    for n in range(levels + 1):
        low, high = -F.shiftright(-start, n), F.shiftright(end, n)
        odd = lambda c: F.pmod(c, F.lit(2)) == 1
        first = F.when(odd(low) & (low < high), made(n, low))
        last = F.when(odd(high) & (low < high), made(n, high - 1))
        found += [first, last]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def cells(start: Column, end: Column, levels: int) -> Column:
    """array<struct<level, cell>>: the fewest cells that make up start to end, none if
    end is less than start."""
    return _tiles(start, end, levels, lambda n, cell: F.struct(F.lit(n).alias("level"), cell.alias("cell")))


def _code(level: int, cell: Column) -> Column:
    """One number of a cell: its middle, doubled."""
    return F.shiftleft(cell, level + 1).bitwiseOR(F.lit(1 << level).cast("long"))


def within(points: DataFrame, ranges: DataFrame, on: list[str], point: str, start: str, end: str, levels: int | None = None) -> DataFrame:
    """``points`` joined with the ``ranges`` of equal columns ``on`` that hold their ``point``."""
    levels = _levels(ranges, start, end) if levels is None else levels
    of = F.array(*(_code(n, F.shiftright(F.col(point).cast("long"), n)) for n in range(levels + 1)))
    x = points.select("*", F.explode(of).alias("__c"))
    y = ranges.select("*", F.explode(_tiles(F.col(start), F.col(end), levels, _code)).alias("__c"))
    # The condition parts cells of numbers that are 2^63 apart.
    return x.join(y, [*on, "__c"]).where(F.col(point).between(F.col(start), F.col(end))).drop("__c")


def overlapping(x: DataFrame, y: DataFrame, on: list[str], s1: str, e1: str, s2: str, e2: str) -> DataFrame:
    """Pairs of ranges of ``x`` (s1, e1) and ``y`` (s2, e2) that share a line, once each. A range
    that ends before its start shares none."""
    x, y = x.where(F.col(s1) <= F.col(e1)), y.where(F.col(s2) <= F.col(e2))
    first = within(y, x, on, s2, s1, e1)
    second = within(x, y, on, s1, s2, e2).where(F.col(s1) > F.col(s2))
    return first.unionByName(second)


def containing(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """(key, child, parent) where every range of ``children(key, child, start, end)``
    lies inside some range of ``parents(key, parent, start, end)``."""
    ranged = children.select(key, "child", F.col("start").alias("s1"), F.col("end").alias("e1")).distinct()
    inside = within(ranged, parents.select(key, "parent", F.col("start").alias("s2"), F.col("end").alias("e2")), [key], "s1", "s2", "e2").where("e1 <= e2 and child <> parent")
    covered = inside.select(key, "child", "parent", "s1", "e1").distinct().groupBy(key, "child", "parent").agg(F.count(F.lit(1)).alias("n"))
    return covered.join(ranged.groupBy(key, "child").agg(F.count(F.lit(1)).alias("n")), [key, "child", "n"]).select(key, "child", "parent")


def smallest_containing(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Of a child's containing parents the one with the fewest lines (sums of
    range lengths), then the least id."""
    lines = parents.groupBy(key, "parent").agg(F.sum(F.col("end") - F.col("start") + 1).alias("lines"))
    found = containing(parents, children, key).join(lines, [key, "parent"])
    return found.groupBy(key, "child").agg(F.min_by("parent", F.struct("lines", "parent")).alias("parent"))


def nearest(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """(key, child, parent, distance): the parent with the smallest gap of lines to
    a child (0 when they touch or overlap), the least id on ties. A gap is the greatest of 0,
    ``start - parent's end - 1`` and ``parent's start - end - 1``, for ranges that end before their start too; nulls are left out.

    Keys with at most ``FEW`` parents compare each child with all of them, so a range is one row of a shuffle. Larger groups
    are swept; only their ranges without a length are compared one by one."""
    parents, children = parents.select(key, "parent", "start", "end"), children.select(key, "child", "start", "end")
    counts = parents.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    rows = (total or 0) + children.count()
    if (most or 0) <= FEW:
        return _least(_compared(parents, children, key, rows), key)
    many = materialise(counts.where(F.col("n") > FEW).select(key), "large-groups")
    few = _compared(*(d.join(many, key, "left_anti") for d in (parents, children)), key, rows)
    parents, children = (d.join(many, key, "left_semi") for d in (parents, children))
    ranged = F.coalesce(F.col("start") <= F.col("end"), F.lit(False))
    swept = _swept(parents.where(ranged), children.where(ranged), key)
    for x, y in ((parents, children.where(~ranged)), (parents.where(~ranged), children.where(ranged))):
        swept = swept.unionByName(_compared(x, y, key, rows))
    return _least(few, key).unionByName(_least(swept, key))


def _least(found: DataFrame, key: str) -> DataFrame:
    return found.groupBy(key, "child").agg(F.min("g").alias("g")).select(key, "child", "g.parent", "g.distance")


def _compared(parents: DataFrame, children: DataFrame, key: str, rows: int) -> DataFrame:
    """(key, child, g: struct<distance, parent>) of all pairs of a key, of about ``rows`` ranges."""
    x, y = dealt(children, rows, key), dealt(parents.select(key, "parent", F.col("start").alias("s2"), F.col("end").alias("e2")), rows, key)
    gap = F.greatest(F.lit(0), F.col("start") - F.col("e2") - 1, F.col("s2") - F.col("end") - 1).cast("long")
    return x.join(y, key).select(key, "child", F.struct(gap.alias("distance"), "parent").alias("g"))


def _swept(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """(key, child, g) with the nearest parent on either side and all that touch or overlap the child."""
    marks = children.select(key, "child", "start", "end", F.lit(None).cast(parents.schema["parent"].dataType).alias("parent")).unionByName(
        parents.select(key, F.lit(None).cast(children.schema["child"].dataType).alias("child"), "start", "end", "parent")
    )
    is_parent = F.col("parent").isNotNull()
    # Reaching furthest among parents that start no later, and starting first among later ones;
    # of those that touch or overlap the child, which may be many, a join of cells finds the least.
    before = Window.partitionBy(key).orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    # Backwards, as a frame that ends with the group would be added up again for every row.
    after = Window.partitionBy(key).orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)
    low = F.min(F.when(is_parent, F.struct((-F.col("end")).alias("back"), "parent"))).over(before)
    high = F.min(F.when(is_parent, F.struct("start", "parent"))).over(after)
    swept = marks.withColumns({"__l": low, "__h": high}).where("child is not null")
    gaps = swept.select(
        key,
        "child",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.greatest(F.lit(0), F.col("start") + F.col("__l.back") - 1).cast("long").alias("distance"), F.col("__l.parent").alias("parent")),
                    F.struct(F.greatest(F.lit(0), F.col("__h.start") - F.col("end") - 1).cast("long").alias("distance"), F.col("__h.parent").alias("parent")),
                ),
                lambda x: x["parent"].isNotNull(),
            )
        ).alias("g"),
    )
    x = children.select(key, "child", (F.col("start") - 1).alias("s1"), (F.col("end") + 1).alias("e1"))
    y = parents.select(key, "parent", F.col("start").alias("s2"), F.col("end").alias("e2"))
    met = overlapping(x, y, [key], "s1", "e1", "s2", "e2").select(key, "child", F.struct(F.lit(0).cast("long").alias("distance"), "parent").alias("g"))
    return gaps.unionByName(met)


def consolidate(bundles: DataFrame, key: str, target: str) -> DataFrame:
    """Merges bundles with one target into the strongest: (key, target, carrier,
    facts, ranges). ``bundles(bundle, strength, pos, facts, ranges)``."""
    w = Window.partitionBy(key, target)
    best = bundles.withColumn("carrier", F.first("bundle").over(w.orderBy(F.col("strength").desc(), "pos")))
    field = lambda c: lambda x: x[c]
    return best.groupBy(key, target, "carrier").agg(*[F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", c))), field(c)))).alias(c) for c in ("facts", "ranges")])
