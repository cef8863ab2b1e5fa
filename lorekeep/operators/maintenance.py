"""Incremental maintenance: change detection, deletion plans, index upserts, logs.

Everything is joins on keys over current and stored state; nothing is mutated
in place. Where the last of several rows wins, an order column says which it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.intervals import overlapping


def changed_sources(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, hash, status) of ``current(path, hash)`` against ``stored``: ``new``
    without a stored hash, ``baseline`` where it is empty, ``changed``, ``same``."""
    known = stored.select("path", F.col("hash").alias("__old"))
    old = F.col("__old")
    status = F.when(old.isNull(), "new").when(old == "", "baseline").when(old != F.col("hash"), "changed").otherwise("same")
    return current.join(known, "path", "left").select("path", "hash", status.alias("status"))


def deletion_plan(pages: DataFrame, deleted: DataFrame, stems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For ``pages(path, resource array)`` and ``deleted(source, stem)``: (source,
    path, action) with ``delete`` for a page's only source and ``rebuild`` otherwise,
    and (source, remaining): what the rebuilt pages still cite, stems resolved by
    ``stems(stem, path)`` and unresolved ones dropped."""
    tokens = deleted.select("source", F.explode(F.array_distinct(F.array("source", "stem"))).alias("token"))
    cited = pages.select("path", "resource", F.explode("resource").alias("token"))
    hit = cited.join(tokens, "token").groupBy("source", "path").agg(F.first("resource").alias("resource"))
    plan = hit.select("source", "path", F.when(F.size("resource") == 1, "delete").otherwise("rebuild").alias("action"), "resource")
    rest = plan.where("action = 'rebuild'").select("source", F.explode("resource").alias("token")).distinct().join(tokens, ["source", "token"], "left_anti")
    resolved = rest.join(stems.select(F.col("stem").alias("token"), F.col("path").alias("found")), "token", "left")
    direct = F.col("token").endswith(".md") | F.col("token").contains("/")
    remaining = resolved.select("source", F.when(direct, F.col("token")).otherwise(F.col("found")).alias("remaining")).where("remaining is not null").distinct()
    return plan.select("source", "path", "action"), remaining


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace stored ones of the same key, others are kept."""
    return stored.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming.dropDuplicates(keys), allowMissingColumns=True)


def remove(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(gone.select(*keys).distinct(), keys, "left_anti")


def remove_with_authority(stored: DataFrame, gone: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(what stays, what was removed)."""
    return remove(stored, gone, keys), stored.join(gone.select(*keys).distinct(), keys, "left_semi")


def restore(stored: DataFrame, removed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(stored with the removed rows back, conflicts: removed rows whose key exists again)."""
    clash = removed.join(stored.select(*keys).distinct(), keys, "left_semi")
    return stored.unionByName(removed.join(clash.select(*keys).distinct(), keys, "left_anti")), clash


def replace_groups(stored: DataFrame, incoming: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """All rows of the changed ids are replaced by the incoming ones of those ids."""
    ids = changed.select(key).distinct()
    return stored.join(ids, key, "left_anti").unionByName(incoming.join(ids, key, "left_semi"), allowMissingColumns=True)


def last_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def version_diff(old: DataFrame, new: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """(*keys, change): ``added``, ``removed`` or ``modified`` between two versions."""
    a = old.select(*keys, F.struct(*compared).alias("__old"))
    b = new.select(*keys, F.struct(*compared).alias("__new"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "modified")
    return a.join(b, keys, "full").select(*keys, change.alias("change")).where("change is not null")


def merge_by_key(current: DataFrame, incoming: DataFrame, key: str, position: str) -> DataFrame:
    """Incoming rows win by key but keep the current position; new ones follow."""
    last = F.coalesce(current.agg(F.max(position)).scalar(), F.lit(0))
    old = current.select(key, F.col(position).alias("__old"))
    placed = incoming.join(old, key, "left").withColumn(position, F.coalesce("__old", last + F.col(position) + 1)).drop("__old")
    return current.join(incoming.select(key), key, "left_anti").unionByName(placed.select(*current.columns))


def consolidate_prefixes(paths: DataFrame, path: str = "path") -> DataFrame:
    """Folders that no other folder of the table contains. A folder's ancestors
    are its own prefixes, so containment is an equi-join."""
    clean = paths.select(F.regexp_replace(F.col(path), "/+\\z", "").alias("p")).distinct()
    parts = F.split("p", "/")
    above = clean.select("p", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("a")).where(F.size(F.split("p", "/")) > 1)
    inside = above.join(clean.select(F.col("p").alias("a")), "a", "left_semi").select("p").distinct()
    return clean.join(inside, "p", "left_anti").select(F.col("p").alias(path))


def route_by_prefix(files: DataFrame, roots: DataFrame, fallback: Column | None = None) -> DataFrame:
    """(path, domain): the first domain, by ``pos``, of ``roots(domain, root, pos)``
    whose root is the file or a folder above it; else the fallback."""
    parts = F.split("path", "/")
    above = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root"))
    clean = roots.select("domain", F.regexp_replace("root", "/+\\z", "").alias("root"), "pos")
    found = above.join(clean, "root").groupBy("path").agg(F.min_by("domain", "pos").alias("domain"))
    return files.select("path").join(found, "path", "left").select("path", F.coalesce("domain", fallback if fallback is not None else F.lit(None).cast("string")).alias("domain"))


def route_entities(pages: DataFrame, entities: DataFrame, classified: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(routed(path, type), rejected(path)): the type by stem, else by the
    classifier's table; a missing type or one not allowed is rejected."""
    typed = pages.join(entities, "stem", "left").join(classified.withColumnRenamed("type", "__guess"), "stem", "left").withColumn("type", F.coalesce("type", "__guess"))
    routed = typed.join(allowed.select("type"), "type", "left_semi").select("path", "type")
    return routed, pages.select("path").join(routed, "path", "left_anti")


def merge_evidence(packets: DataFrame) -> DataFrame:
    """One row an entity of ``packets(entity, pos, facts, ranges, links)``: first
    occurrences in order. Partial results merge the same way again."""
    field = lambda c: lambda x: x[c]
    gathered = packets.groupBy("entity").agg(*[F.transform(F.sort_array(F.collect_list(F.struct("pos", c))), field(c)).alias(c) for c in ("facts", "ranges", "links")])
    return gathered.select("entity", *[F.array_distinct(F.flatten(c)).alias(c) for c in ("facts", "ranges", "links")])


def coverage_gaps(expected: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """(key, problem): ids ``missing``, ``unexpected`` or covered ``twice``."""
    counted = given.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = expected.select(key, F.lit(True).alias("__e")).distinct().join(counted, key, "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("__e").isNull(), "unexpected").when(F.col("n") > 1, "twice")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def line_gaps(sources: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """(key, gap_start, gap_end): lines 1 to ``lines`` of each source that no
    range covers. Ranges are swept in order, so no line is ever listed."""
    w = Window.partitionBy(key).orderBy("start", "end")
    ends = ranges.select(key, "start", "end").unionByName(sources.select(key, (F.col("lines") + 1).alias("start"), (F.col("lines") + 1).alias("end")))
    reach = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ends.withColumn("__r", reach).where(F.col("start") > F.col("__r") + 1).select(key, (F.col("__r") + 1).alias("gap_start"), (F.col("start") - 1).alias("gap_end"))


def overlap_assignment(items: DataFrame, bundles: DataFrame, key: str, item: str, bundle: str) -> DataFrame:
    """(key, item, bundle, overlap): each item's bundle with the most overlapping
    lines, then the primary one, then the first by ``pos``."""
    x = items.select(key, item, F.col("start").alias("s1"), F.col("end").alias("e1"))
    y = bundles.select(key, bundle, "primary", "pos", F.col("start").alias("s2"), F.col("end").alias("e2"))
    met = overlapping(x, y, [key], "s1", "e1", "s2", "e2")
    lines = F.least("e1", "e2") - F.greatest("s1", "s2") + 1
    summed = met.groupBy(key, item, bundle, "primary", "pos").agg(F.sum(lines).alias("overlap"))
    w = Window.partitionBy(key, item).orderBy(F.col("overlap").desc(), F.col("primary").desc(), "pos")
    return summed.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(key, item, bundle, "overlap")


def merge_findings(findings: DataFrame, keys: list[str], position: str) -> DataFrame:
    """First finding of each lower-case, trimmed key."""
    keyed = findings.withColumn("__k", F.concat_ws("\u0001", *[F.lower(F.trim(F.coalesce(F.col(k).cast("string"), F.lit("")))) for k in keys]))
    w = Window.partitionBy("__k").orderBy(position)
    return keyed.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__k")


def evidence_strength(facts: Column, ranges: Column, chars: Column) -> Column:
    """16 a fact, 8 a range, 4 a covered line, and up to 16 for length."""
    lines = F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"] + 1)
    return 16 * F.size(facts) + 8 * F.size(ranges) + 4 * lines + F.least(F.lit(16.0), chars / 128)


def tag_rollup(tags: DataFrame, key: str, raw: Column) -> DataFrame:
    """(category, tag, n, level): counts of valid tags and of their categories."""
    from lorekeep.functions.text import tag

    clean = tags.select(key, tag(raw).alias("tag")).where(F.col("tag").rlike(r"\A[\p{L}\p{N}][\p{L}\p{N}_\-]*(/[\p{L}\p{N}][\p{L}\p{N}_\-]*)*\z"))
    counted = clean.withColumn("category", F.split("tag", "/")[0]).rollup("category", "tag").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    return counted.select("category", "tag", "n", F.col("level").cast("int").alias("level"))


def fixed_batches(rows: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """Rows in order dealt into batches of a fixed size."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) / size).cast("int"))


def capped(rows: DataFrame, group: list[str], order: list[str], cap: int) -> DataFrame:
    """The first ``cap`` rows of each group with the number left out. The group
    limit keeps ``cap`` rows a task before the shuffle; sizes are counted apart."""
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    first = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__r") <= cap)
    return first.join(sizes, group).withColumn("overflow", F.greatest(F.lit(0), F.col("__n") - cap)).drop("__r", "__n")
