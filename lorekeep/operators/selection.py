"""Choosing rows under constraints: context of an entity, halved parts, feasible
budgets, slots of a fused ranking, authorities of submitted sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators.context import greedy_pack
from lorekeep.storage import materialise


def entity_context(sections: DataFrame, group: list[str], page: str, position: str, score: str, text: str, cost: str, budget: int, target: Column | None = None) -> DataFrame:
    """(*group, id, cost, kept, used, round) of the sections of each group's pages.

    Of sections with one normalised text the target page's counts, else the best
    scored, then the first. The best section of the target page comes first (round 0);
    the others follow in rounds, the n-th best of every page in round n, and enter greedily."""
    key = T.chunk_key(F.lit(""), F.col(text))
    aim = F.coalesce(target, F.lit(False)) if target is not None else F.lit(False)
    keyed = sections.select(*group, page, position, score, cost, key.alias("__k"), aim.alias("__aim"))
    order = [F.col("__aim").desc(), F.col(score).desc(), F.col(page), F.col(position)]
    one = keyed.withColumn("__r", F.row_number().over(Window.partitionBy(*group, "__k").orderBy(*order))).where("__r = 1")
    nth = F.row_number().over(Window.partitionBy(*group, page).orderBy(F.col(score).desc(), position)) - F.when(F.col("__aim"), 1).otherwise(0)
    rounds = one.withColumns({"round": nth.cast("int"), "down": -F.col(score).cast("double"), "id": F.struct(page, position)})
    packed = greedy_pack(rounds, group, "id", cost, budget, ["round", "down", page, position])
    out = packed.join(rounds.select(*group, "id", "round"), [*group, "id"])
    return out.select(*group, F.col(f"id.{page}").alias(page), F.col(f"id.{position}").alias(position), "cost", "kept", "used", "round")


def halved(items: DataFrame, key: list[str], costs: str, budget: int, base: int = 0) -> DataFrame:
    """(*key, low, high, cost): the parts into which items are halved until each
    costs at most ``budget`` or is a single unit. ``costs`` holds the costs of an
    item's units; a part costs ``base`` and those of units low to high - 1. The
    larger half comes first. Rounds grow with the logarithm of the longest item."""
    total = lambda low, high: F.aggregate(F.slice(costs, low + 1, high - low), F.lit(base).cast("long"), lambda s, x: s + x)
    parts = items.select(*key, costs, F.lit(0).alias("low"), F.size(costs).alias("high"))
    parts = parts.withColumn("cost", total(F.col("low"), F.col("high")))
    longest = parts.agg(F.max("high")).first()[0] or 1
    over = (F.col("cost") > budget) & (F.col("high") - F.col("low") > 1)
    for n in range(max(1, (longest - 1).bit_length())):
        middle = F.ceil((F.col("low") + F.col("high")) / 2).cast("int")
        whole = F.array(F.struct("low", "high"))
        two = F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high"))
        parts = parts.select(*key, costs, F.explode(F.when(over, two).otherwise(whole)).alias("p")).select(*key, costs, "p.low", "p.high")
        parts = parts.withColumn("cost", total(F.col("low"), F.col("high")))
        if n % 8 == 7:
            parts = materialise(parts, "halved")
    return parts.select(*key, "low", "high", "cost")


def largest_feasible(trials: DataFrame, group: list[str], budget: str, verdict: str) -> DataFrame:
    """(*group, budget): the largest budget judged feasible. Verdicts are monotone
    (too small, feasible, too large), so this is what a search by halves would find."""
    best = F.max(F.when(F.col(verdict) == "feasible", F.col(budget)))
    return trials.groupBy(*group).agg(best.alias(budget)).where(F.col(budget).isNotNull())


def fixed_slots(lists: DataFrame, group: list[str], limit: int, fused: str = "fused", pages: str = "pages", chunks: str = "chunks", legacy: str = "legacy") -> DataFrame:
    """(*group, id, slot): the fused top with missing page and chunk leaders put in
    from its end. Each column holds a ranked list of ids, of which ``limit`` are read.

    A page leader takes the last slot that neither a page leader holds nor, if it is
    a legacy leader too, another of these; else nor a chunk leader, nor (from the third
    page on) a legacy leader. Then the first three chunks take slots that neither the
    first three pages nor the first four chunks hold."""
    first = lambda c, n: F.slice(F.array_distinct(F.col(c)), 1, n)
    kind = lists.schema[fused].dataType.elementType.simpleString()
    named = lists.select(*group, first(fused, limit).alias("t"), *[F.slice(c, 1, limit).alias(n) for c, n in ((pages, "p"), (chunks, "c"), (legacy, "l"))], F.slice(chunks, 1, 4).alias("c4"))

    def place(top: Column, candidate: Column, free) -> Column:
        """``candidate`` in the last free slot of ``top``, unless it is there."""
        slots = F.transform(top, lambda x, i: F.when(free(x), i))
        last = F.array_max(slots)
        put = F.transform(top, lambda x, i: F.when(i == last, candidate).otherwise(x))
        return F.when(F.array_contains(top, candidate) | last.isNull(), top).otherwise(put)

    def page(top: Column, m: Column) -> Column:
        out = lambda c, x: ~F.array_contains(c, x)
        p, c, leg = F.col("p"), F.col("c"), F.col("l")
        free = lambda x: out(p, x) & F.when(F.array_contains(leg, m["x"]), out(leg, x)).otherwise(out(c, x) & (out(leg, x) | (m["i"] < 2)))
        return place(top, m["x"], free)

    start = F.col("t").cast(f"array<{kind}>")
    with_pages = named.withColumn("t", F.aggregate(F.transform("p", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), start, page))
    kept = lambda x: F.array_contains(F.slice("p", 1, 3), x) | F.array_contains("c4", x)
    with_chunks = with_pages.withColumn("t", F.aggregate(F.slice("c", 1, min(3, limit)), F.col("t"), lambda top, x: place(top, x, lambda y: ~kept(y))))
    return with_chunks.select(*group, F.posexplode(F.array_distinct("t")).alias("slot", "id"))


def replace_authorities(items: DataFrame, sections: DataFrame, by: list[str]) -> DataFrame:
    """Sections of ``sections`` that were submitted exactly: equal in all columns ``by``."""
    return sections.join(items.select(*by).distinct(), by, "left_semi")


def replace_pages(records: DataFrame, pages: DataFrame, is_page: Column, key: str) -> DataFrame:
    """``records`` with its page rows replaced by ``pages``. ``position`` orders the
    result: other rows as they were (by their own ``position``), then pages by ``key``."""
    others = records.where(~is_page)
    new = pages.select(*[c for c in records.columns if c != "position"]).withColumn("position", F.lit(None).cast("long"))
    return others.unionByName(new).select("*", F.struct(F.col("position").isNull().alias("page"), "position", F.when(F.col("position").isNull(), F.col(key)).alias("key")).alias("place"))


def foreign_urls(pages: DataFrame, sources: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, url): URLs of a page that none of its sources (rows of the same key) holds."""
    found = lambda df: df.select(key, F.explode(T.urls(F.col(text))).alias("url")).distinct()
    return found(pages).join(found(sources), [key, "url"], "left_anti")


def latency_verdict(runs: DataFrame, variant: str, latency: str, quality: str, most_ms: float, least_quality: float) -> DataFrame:
    """(variant, p95, quality, accepted): variants whose 95th percentile and mean
    quality are within bounds; the percentile is the nearest rank."""
    out = runs.groupBy(variant).agg(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY `{latency}`)").alias("p95"), F.round(F.avg(quality), 6).alias("quality"))
    return out.withColumn("accepted", (F.col("p95") <= most_ms) & (F.col("quality") >= least_quality))


def export_tags(tags: Column) -> Column:
    """Distinct normalised tags in order, a dash for each slash."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.replace(T.tag(t), F.lit("/"), F.lit("-"))), lambda t: t != ""))


def source_token(token: Column) -> Column:
    """An entry of a source list without white space and one quote at each end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(T.text_or_empty(token), r"\A\s+|\s+\z", ""), r"\A[\"']|[\"']\z", ""), r"\A\s+|\s+\z", "")


def summary_vectors(chunks: DataFrame, page: str, kind: str = "kind", vector: str = "vector") -> DataFrame:
    """The summary chunks of pages that have a vector."""
    return chunks.where((F.col(kind) == "summary") & (F.size(F.coalesce(vector, F.array().cast("array<float>"))) > 0)).select(page, vector)
