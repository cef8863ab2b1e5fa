"""Integrity of pages, sources, actions and reductions: joins and check columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators.context import greedy_pack


def title_map(pages: DataFrame) -> DataFrame:
    """(title, stem) of ``pages(stem, title, h1, pos)``: lower-case titles, else first
    headings; of pages with one title the last."""
    titled = pages.select("stem", "pos", F.lower(F.trim(F.coalesce(F.nullif(F.trim("title"), F.lit("")), "h1"))).alias("title")).where("title <> ''")
    return titled.groupBy("title").agg(F.max_by("stem", "pos").alias("stem"))


def checked_sources(entries: DataFrame, stems: DataFrame, titles: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(path, pos, entry, status) of ``entries(path, pos, entry)``: ``kept`` if a
    source has that stem, ``renamed`` where a title leads to one (``entry`` is
    replaced), ``dropped`` if it is unknown or the stem of a page."""
    known = stems.select(F.col("stem").alias("entry"), F.lit(True).alias("__known")).distinct()
    own = forbidden.select(F.col("stem").alias("entry"), F.lit(True).alias("__own")).distinct()
    named = titles.select(F.col("title").alias("__low"), F.col("stem").alias("__stem"))
    rows = entries.withColumn("__low", F.lower(F.trim("entry"))).join(known, "entry", "left").join(own, "entry", "left").join(named, "__low", "left")
    status = F.when(F.col("__own").isNotNull(), "dropped").when(F.col("__known").isNotNull(), "kept").when(F.col("__stem").isNotNull(), "renamed").otherwise("dropped")
    return rows.select("path", "pos", F.when(status == "renamed", F.col("__stem")).otherwise(F.col("entry")).alias("entry"), status.alias("status"))


def related_sections(items: DataFrame, submitted: DataFrame, budget: int) -> DataFrame:
    """(batch, id, cost, kept, used): sections of ``items(id, text, cost)`` that share
    words with a batch of ``submitted(batch, id, text)``, by shared words, greedily
    packed. Sections meet a batch through their words, never each with each."""
    words = submitted.select("batch", F.explode(T.query_tokens(F.col("text"))).alias("w")).distinct()
    own = submitted.select("batch", "id")
    held = items.select("id", "cost", F.explode(F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"[\p{L}\p{N}]{3,}"), 0)).alias("w")).groupBy("id", "cost", "w").agg(F.count(F.lit(1)).alias("n"))
    shared = held.join(words, "w").groupBy("batch", "id", "cost").agg(F.sum("n").alias("shared")).join(own, ["batch", "id"], "left_anti")
    return greedy_pack(shared.withColumn("order", -F.col("shared")), ["batch"], "id", "cost", budget, ["order", "id"])


def action_problems(actions: DataFrame, pages: DataFrame) -> DataFrame:
    """(path, problem) of ``actions(action, path, hash)``: a path twice, creating
    what exists, patching what does not, or a page that changed since (``pages(path, hash)``)."""
    twice = actions.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("path", F.lit("duplicate path").alias("problem"))
    joined = actions.join(pages.select("path", F.col("hash").alias("__now")), "path", "left")
    problem = (
        F.when((F.col("action") == "create") & F.col("__now").isNotNull(), "page exists")
        .when((F.col("action") == "patch") & F.col("__now").isNull(), "page does not exist")
        .when((F.col("action") == "patch") & (F.col("hash") != F.col("__now")), "stale page")
    )
    return twice.unionByName(joined.select("path", problem.alias("problem")).where("problem is not null"))


def reduction_problems(consumed: DataFrame, reduced: DataFrame) -> DataFrame:
    """(entity, field, value, problem): values of ``consumed(entity, field, value)``
    that a reduction lost, and values that it made up."""
    keys = ["entity", "field", "value"]
    lost = consumed.select(*keys).distinct().join(reduced, keys, "left_anti").withColumn("problem", F.lit("lost"))
    return lost.unionByName(reduced.select(*keys).distinct().join(consumed, keys, "left_anti").withColumn("problem", F.lit("made up")))


def context_pages(pages: DataFrame, group: list[str], limit: int) -> DataFrame:
    """The first pages of ``pages(id, seed, fused_rank, pos)`` for a context: by fused
    rank where there is one, else seeds first, then in order of discovery."""
    w = Window.partitionBy(*group).orderBy(F.col("fused_rank").asc_nulls_last(), F.col("seed").desc(), "pos")
    return pages.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def global_ranges(packets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk-local ranges of ``packets(chunk, entity, start, end)`` as lines of the
    source, with a flag whether they lie inside the chunk (``chunks(chunk, first_line, last_line)``)."""
    placed = packets.join(chunks, "chunk")
    start, end = F.col("first_line") + F.col("start") - 1, F.col("first_line") + F.col("end") - 1
    return placed.select("chunk", "entity", start.alias("start"), end.alias("end"), ((F.col("start") >= 1) & (F.col("start") <= F.col("end")) & (end <= F.col("last_line"))).alias("valid"))
