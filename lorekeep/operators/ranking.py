"""Rank fusion, demotion, guarded reranking and retrieval metrics.

Ranked lists are rows with an explicit rank; everything is per query, so windows
partition by the query and a shuffle carries only short lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(ranked: DataFrame, group: list[str], id_: str, list_no: str = "list_no", rank: str = "rank", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: (*group, id, score, rank). A list's repeated ids
    add up; ties go to the id seen first, over lists and then ranks."""
    fused = ranked.groupBy(*group, id_).agg(F.round(F.sum(1 / (F.lit(k) + F.col(rank))), 9).alias("score"), F.min(F.struct(list_no, rank)).alias("__first"))
    w = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("__first"))
    return fused.withColumn("rank", F.row_number().over(w)).drop("__first")


def unique_ranks(ranked: DataFrame, group: list[str], id_: str, rank: str = "rank") -> DataFrame:
    """Each id once at its best place, ranks closed up."""
    best = ranked.groupBy(*group, id_).agg(F.min(rank).alias("__r"))
    return best.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy("__r"))).drop("__r")


def fuse_lexical(pages: DataFrame, chunks: DataFrame, group: list[str], limit: int, k: int = RRF_K, extra: list[DataFrame] = ()) -> DataFrame:
    """RRF of page ranks, chunk ranks by article, and further lists of (group, id, rank)."""
    lists = [pages, chunks, *extra]
    named = [unique_ranks(d, group, "id").withColumn("list_no", F.lit(i)) for i, d in enumerate(lists)]
    out = named[0]
    for d in named[1:]:
        out = out.unionByName(d)
    return rrf(out, group, "id", k=k).where(F.col("rank") <= limit)


def fuse_vector_graph(candidates: DataFrame, group: list[str], k: int = RRF_K) -> DataFrame:
    """Fuses two orders of ``candidates(id, pos, score, hop, degree)``: score
    descending, and hop ascending then degree descending; ``pos`` breaks ties."""
    by_score = Window.partitionBy(*group).orderBy(F.coalesce("score", F.lit(0.0)).desc(), "pos")
    by_graph = Window.partitionBy(*group).orderBy("hop", F.coalesce("degree", F.lit(0)).desc(), "pos")
    a = candidates.select(*group, "id", F.lit(0).alias("list_no"), F.row_number().over(by_score).alias("rank"))
    b = candidates.select(*group, "id", F.lit(1).alias("list_no"), F.row_number().over(by_graph).alias("rank"))
    return rrf(a.unionByName(b), group, "id", k=k)


def penalty(size: Column, limit: int, factor: float) -> Column:
    """How far ``demote`` pushes a flagged row of a list of ``size`` rows back."""
    return F.greatest(F.lit(1), F.ceil(F.lit(factor) * F.greatest(F.lit(limit), size) * 2))


def demote(ranked: DataFrame, group: list[str], flagged: Column, limit: int, factor: float = 0.15, enabled: bool = True, size: Column | None = None) -> DataFrame:
    """Pushes flagged rows of ``ranked(rank)`` back by a share of the list and
    closes up; without it the list is only cut. ``size`` is the whole list's, where ``ranked``
    holds only its first ``limit`` rows of either kind."""
    if limit <= 0:
        return ranked.where(F.lit(False))
    factor = max(0.0, min(1.0, factor))
    if not enabled or factor <= 0:
        return ranked.where(F.col("rank") <= limit)
    size = F.count(F.lit(1)).over(Window.partitionBy(*group)) if size is None else size
    moved = ranked.withColumn("__moved", F.col("rank") + F.when(flagged, penalty(size, limit, factor)).otherwise(0))
    w = Window.partitionBy(*group).orderBy("__moved", "rank")
    return moved.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("__moved")


def unique_top(ranked: DataFrame, group: list[str], id_: str, limit: int) -> DataFrame:
    return unique_ranks(ranked, group, id_).where(F.col("rank") <= limit)


def overlap_ratio(a: DataFrame, b: DataFrame, group: list[str], id_: str, limit: int) -> DataFrame:
    """Share of two rankings' first ``limit`` that they have in common."""
    x, y = (d.where(F.col("rank") <= limit).select(*group, id_).distinct() for d in (a, b))
    sizes = x.groupBy(*group).agg(F.count(F.lit(1)).alias("na")).join(y.groupBy(*group).agg(F.count(F.lit(1)).alias("nb")), group, "full")
    shared = x.join(y, [*group, id_]).groupBy(*group).agg(F.count(F.lit(1)).alias("shared"))
    least = F.least(F.lit(limit), F.greatest(F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))))
    return sizes.join(shared, group, "left").select(*group, F.round(F.coalesce("shared", F.lit(0)) / F.greatest(least, F.lit(1)), 6).alias("overlap"))


def gold_metrics(ranked: DataFrame, gold: DataFrame, query: str, id_: str, k: int) -> DataFrame:
    """Recall (over min(k, labels)), nDCG (gold-only ideal cut at k) and MRR
    within k of each query in ``gold(query, id, grade)``."""
    top = ranked.where(F.col("rank") <= k)
    hits = top.join(gold.select(query, id_, "grade"), [query, id_])
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)
    found = hits.groupBy(query).agg(F.count(F.lit(1)).alias("hits"), F.sum(gain).alias("dcg"), F.min("rank").alias("first"))
    ordered = gold.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.col("grade").desc(), id_)))
    ideal = ordered.groupBy(query).agg(F.count(F.lit(1)).alias("labels"), F.sum(F.when(F.col("rank") <= k, gain)).alias("ideal"))
    return ideal.join(found, query, "left").select(
        query,
        F.round(F.coalesce("hits", F.lit(0)) / F.least(F.lit(k), F.col("labels")), 6).alias("recall"),
        F.round(F.when(F.col("ideal") == 0, 0.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")), 6).alias("ndcg"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
    )


def gold_problems(gold: DataFrame, queries: DataFrame, known: DataFrame, query: str, id_: str) -> DataFrame:
    """(query, id, problem) rows: unknown or missing queries, repeated labels,
    unknown documents and grades out of range."""
    rows = gold.select(query, id_, "grade")
    nothing = F.lit(None).cast(rows.schema[id_].dataType)
    unknown = rows.join(queries.select(query), query, "left_anti").select(query, nothing.alias(id_), F.lit("unknown query").alias("problem")).distinct()
    missing = queries.select(query).join(rows, query, "left_anti").select(query, nothing.alias(id_), F.lit("missing labels").alias("problem"))
    twice = rows.groupBy(query, id_).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(query, id_, F.lit("duplicate label").alias("problem"))
    absent = rows.join(known.select(id_), id_, "left_anti").select(query, id_, F.lit("unknown document").alias("problem"))
    grades = rows.where(~F.coalesce(F.col("grade").isin(1, 2, 3), F.lit(False))).select(query, id_, F.lit("invalid grade").alias("problem"))
    return unknown.unionByName(missing).unionByName(twice).unionByName(absent).unionByName(grades)


def variant_matrix(results: DataFrame, group: list[str]) -> DataFrame:
    """Averages, guards and distinct reasons of ``results(recall, ndcg, mrr, ok, boilerplate, reason)``."""
    return results.groupBy(*group).agg(
        F.round(F.avg("recall"), 6).alias("recall"),
        F.round(F.avg("ndcg"), 6).alias("ndcg"),
        F.round(F.avg("mrr"), 6).alias("mrr"),
        F.bool_and("ok").alias("all_ok"),
        F.bool_or("boilerplate").alias("any_boilerplate"),
        F.array_join(F.sort_array(F.collect_set("reason")), ", ").alias("reasons"),
    )


def best_variant(matrix: DataFrame, least_mrr: float = 0.9) -> DataFrame:
    """The best eligible row: no boilerplate on top and enough MRR, else the best of all."""
    eligible = (F.col("mrr") >= least_mrr) & ~F.col("any_boilerplate")
    return matrix.orderBy(eligible.desc(), F.col("ndcg").desc(), F.col("recall").desc(), F.col("mrr").desc(), *[F.col(c) for c in matrix.columns]).limit(1)


def guarded_rerank(
    ranked: DataFrame,
    group: list[str],
    article: str,
    base_score: str,
    score: str,
    limit: int,
    alpha: float = 0.6,
    max_promotion: int = 1,
    least_gap: float = 0.2,
    least_base_ratio: float = 0.95,
    max_target: int = 3,
) -> DataFrame:
    """Reorders chunks of ``ranked(rank)`` by a reranker's scores, page by page.

    A page's strength is ``1 / place + alpha * scaled score``. By strength, pages ask
    for a slot ``max_promotion`` above their place, but keep their own if that slot
    is beyond ``max_target``, their score is not ``least_gap`` above the score of the page there,
    or their base score falls below a share of that page's. Taken slots push a
    page down to the next free one: a fold over one query's few pages. Chunks then interleave page by page."""
    w = Window.partitionBy(*group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    scaled = F.when(F.col(score).isNull(), 0.0).when(high > low, (F.col(score) - low) / (high - low)).otherwise(1.0)
    chunks = ranked.withColumns({"__s": scaled, "__round": F.row_number().over(Window.partitionBy(*group, article).orderBy("rank"))})
    pages = chunks.groupBy(*group, article).agg(F.min("rank").alias("__first"), F.max("__s").alias("s"), F.max(base_score).alias("base"))
    by_place = w.orderBy("__first")
    pages = pages.withColumn("place", F.row_number().over(by_place) - 1)
    target = F.greatest(F.lit(0), F.col("place") - max_promotion)
    # The page that holds the wanted slot now; near the top that is the first.
    above = {c: F.coalesce(F.lag(c, max_promotion).over(by_place), F.first(c).over(by_place)) for c in ("s", "base")}
    stays = (target > max_target) | (F.col("s") - above["s"] < least_gap) | (F.col("base") < above["base"] * least_base_ratio)
    pages = pages.withColumns({"want": F.when((target < F.col("place")) & ~stays, target).otherwise(F.when(target < F.col("place"), F.col("place")).otherwise(target)), "strength": 1 / (F.col("place") + 1) + alpha * F.col("s")})
    kind = ranked.schema[article].dataType.simpleString()
    start = F.array().cast(f"array<struct<article:{kind},slot:int>>")
    rows = pages.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct((-F.col("strength")).alias("k"), "place", "want", F.col(article).alias("article")))).alias("p"))

    def seat(n):
        def run(taken, page):
            free = F.array_except(F.sequence(page["want"], n - 1), F.transform(taken, lambda t: t["slot"]))
            # With every slot below taken there is none; the page then goes last.
            return F.array_append(taken, F.struct(page["article"].alias("article"), F.coalesce(F.array_min(free), n).cast("int").alias("slot")))

        return run

    seated = rows.select(*group, F.explode(F.aggregate("p", start, seat(F.size("p")))).alias("x")).select(*group, F.col("x.article").alias(article), F.col("x.slot").alias("__slot"))
    placed = chunks.join(seated, [*group, article])
    order = w.orderBy("__round", "__slot", "rank")
    return placed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("__s", "__round", "__slot")


def percentile_linear(column: str, q: float) -> Column:
    """Linear interpolation between the nearest ranks."""
    return F.percentile(column, F.lit(q))


def percentile_floor(column: str, q: float) -> Column:
    """The value at index ``floor(n * q)`` of the sorted values."""
    values = F.sort_array(F.collect_list(column))
    return F.element_at(values, F.least(F.floor(F.size(values) * q), F.size(values) - 1).cast("int") + 1)


def percentile_nearest(column: str, q: float) -> Column:
    """The value at index ``ceil(n * q) - 1`` of the sorted values."""
    values = F.sort_array(F.collect_list(column))
    return F.element_at(values, F.greatest(F.ceil(F.size(values) * q), F.lit(1)).cast("int"))
