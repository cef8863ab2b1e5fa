"""Queries over vectors: search, pooling, similarity joins, floors, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.operators import demotion, export, floors, lexical, ranking, similarity_join, vectors
from lorekeep.plans import indexes
from lorekeep.plans.registry import query, sql_set, sql_tokens
from lorekeep.storage import load

_V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_PAIRS = f"""{_V}, s AS (SELECT q.vec_id AS query, v.vec_id AS id, v.label AS label, round(list_cosine_similarity(q.e, v.e), 6) AS cosine
    FROM v q JOIN v ON q.vec_id % 100 = 0)"""


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The stated query set, every hundredth vector, and all vectors."""
    rows = load(spark, d, "embeddings")
    return rows.where("vec_id % 100 = 0"), rows


@query(f"""WITH {_PAIRS} SELECT query, id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS rank FROM s WHERE query <> id) WHERE rank <= 10""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    q, rows = _split(spark, d)
    return vectors.top_k(q, rows, "vec_id", "embedding", 10)


@query(f"WITH {_PAIRS} SELECT query, label, greatest(0, max(cosine)) AS cosine FROM s GROUP BY query, label")
def maxpool_by_label(spark: SparkSession, d: str) -> DataFrame:
    q, rows = _split(spark, d)
    return vectors.max_pooled(q, rows, "vec_id", "embedding", "label").select("query", F.col("group").alias("label"), "cosine")


@query(f"""WITH {_V}, p AS (SELECT a.label AS a, b.label AS b, greatest(0, max(round(list_cosine_similarity(a.e, b.e), 6))) AS score FROM v a JOIN v b ON a.label < b.label GROUP BY ALL)
    SELECT a, b, score FROM p WHERE score >= 0.3""")
def near_dup_label_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of labels (pages) whose vectors' best cosine reaches the threshold."""
    return similarity_join.similar_groups(load(spark, d, "embeddings"), "vec_id", "embedding", "label", 0.3)


@query(f"""WITH {_V}, l AS (SELECT a.vec_id AS id, b.vec_id AS other FROM v a JOIN v b ON a.vec_id <> b.vec_id AND round(list_cosine_similarity(a.e, b.e), 6) >= 0.5)
    SELECT v.vec_id AS id, count(l.other) AS links, least(v.vec_id, coalesce(min(l.other), v.vec_id)) AS least FROM v LEFT JOIN l ON l.id = v.vec_id GROUP BY v.vec_id""")
def near_dup_vectors(spark: SparkSession, d: str) -> DataFrame:
    return similarity_join.similarity_links(load(spark, d, "embeddings"), "vec_id", "embedding", 0.5)


@query(f"""WITH {_V}, t AS (SELECT unnest([0.5, 0.7, 0.9])::DOUBLE AS threshold), p AS (SELECT round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM v a JOIN v b ON a.vec_id <> b.vec_id)
    SELECT threshold, count(cosine) AS links, true AS reached FROM t LEFT JOIN p ON cosine >= threshold GROUP BY threshold""")
def projected_recall(spark: SparkSession, d: str) -> DataFrame:
    """Links at three thresholds, and whether random projections found nine of ten."""
    rows = load(spark, d, "embeddings")
    return similarity_join.measured_recalls(rows, "vec_id", "embedding", [0.5, 0.7, 0.9]).select("threshold", "links", (F.col("recall") >= 0.9).alias("reached"))


@query(f"""WITH {_PAIRS}, f AS (SELECT query, quantile_cont(cosine, 0.05) AS low, max(cosine) AS high FROM s GROUP BY query),
    b AS (SELECT *, round(CASE WHEN high - low < 1e-6 THEN low ELSE low + 0.6::DOUBLE * (high - low) END, 6) AS bar FROM f)
    SELECT query, bar, count_if(cosine >= bar OR high - low < 1e-6) AS kept, count(*) AS n FROM s JOIN b USING (query) GROUP BY query, bar""")
def floor_prune(spark: SparkSession, d: str) -> DataFrame:
    q, rows = _split(spark, d)
    return floors.prune_counts(q, rows, "vec_id", "embedding")


@query(f"""WITH {_PAIRS}, f AS (SELECT query, quantile_cont(cosine, 0.05) AS low, max(cosine) AS high FROM s GROUP BY query),
    x AS (SELECT ratio, s.query, 100 + id % 7 AS tokens, label = query % 10 AS gold, ratio <= 0 OR high - low < 1e-6 OR cosine >= low + ratio * (high - low) AS keep
      FROM s JOIN f USING (query), (VALUES (0.0::DOUBLE), (0.3::DOUBLE), (0.6::DOUBLE), (0.9::DOUBLE)) r(ratio)),
    p AS (SELECT ratio, query, sum(tokens) AS a, sum(CASE WHEN keep THEN 0 ELSE tokens END) AS c, count_if(gold) AS g, count_if(gold AND keep) AS k FROM x GROUP BY ALL)
    SELECT ratio, round(100 * sum(c) / greatest(sum(a), 1), 6) AS cut_percent, round(min(CASE WHEN g = 0 THEN 1 ELSE k / g END), 6) AS least_recall, count_if(g > 0 AND k < g) AS failing FROM p GROUP BY ratio""")
def floor_sweep(spark: SparkSession, d: str) -> DataFrame:
    q, rows = _split(spark, d)
    rows = rows.withColumn("tokens", 100 + F.col("vec_id") % 7)
    return floors.sweep_counts(q.withColumn("want", (F.col("vec_id") % 10).cast("int")), rows, "vec_id", "embedding", "tokens", "want", "label", [0.0, 0.3, 0.6, 0.9])


@query("""SELECT vec_id, coalesce(len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0, false) AS usable FROM embeddings""")
def usable_vectors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select("vec_id", vectors.usable(F.col("embedding"), 64).alias("usable"))


_TOK = sql_tokens("text")


@query(f"""WITH t AS (SELECT doc_id, {sql_set(_TOK)} AS t FROM documents), b AS (SELECT item_id, {sql_set(_TOK)} AS t FROM benchmark),
    d AS (SELECT doc_id, len(t) AS nd, unnest(t) AS w FROM t), q AS (SELECT item_id, len(t) AS nq, unnest(t) AS w FROM b),
    j AS (SELECT item_id, doc_id, round(count(*) / (any_value(nq) + any_value(nd) - count(*)), 6) AS x FROM q JOIN d USING (w) GROUP BY ALL),
    a AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY x DESC, doc_id) AS rank FROM j),
    {{bm}},
    l AS (SELECT item_id, doc_id, rank, 0 AS n FROM a WHERE rank <= 50 UNION ALL SELECT item_id, doc_id, rank, 1 FROM m WHERE rank <= 50),
    r AS (SELECT item_id, doc_id, round(sum(1 / (60 + rank)), 9) AS score, min(n * 1000 + rank) AS first FROM l GROUP BY ALL)
    SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first) AS rank FROM r) WHERE rank <= 20""".replace(
        "{bm}",
        f"""d2 AS (SELECT doc_id, {_TOK} AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d2), e AS (SELECT doc_id, len(t) AS l, unnest(t) AS w FROM d2),
    c AS (SELECT doc_id, l, w, count(*) AS tf FROM e GROUP BY ALL), f AS (SELECT w, count(*) AS df FROM c GROUP BY w),
    s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM q JOIN c USING (w) JOIN f USING (w), n GROUP BY ALL),
    m AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)""",
    ))
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """RRF of the 50 best documents by token-set similarity and by BM25."""
    q, docs = load(spark, d, "benchmark"), load(spark, d, "documents")
    a = lexical.best_jaccard(q, docs, "item_id", "doc_id", limit=50).select("item_id", "doc_id", "rank", F.lit(0).alias("list_no"))
    b = lexical.search_bm25(q, indexes.document_index(spark, d), "item_id", "doc_id", 50).select("item_id", "doc_id", "rank", F.lit(1).alias("list_no"))
    return ranking.rrf(a.unionByName(b), ["item_id"], "doc_id").where("rank <= 20")


@query(f"""WITH {_PAIRS}, r AS (SELECT query, id, label, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS rank FROM s),
    p AS (SELECT *, rank + CASE WHEN label = 0 THEN greatest(1, ceil(0.15 * greatest(20, count(*) OVER (PARTITION BY query)) * 2)) ELSE 0 END AS moved FROM r)
    SELECT query, id, rank FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY moved, rank) AS rank FROM p) WHERE rank <= 20""")
def demoted_topk(spark: SparkSession, d: str) -> DataFrame:
    q, rows = _split(spark, d)
    return demotion.top_demoted(q, rows, "vec_id", "embedding", F.col("label") == 0, 20)


@query(f"""WITH {_PAIRS}, g AS (SELECT query, max(cosine) AS dense_max FROM s WHERE query <> id GROUP BY query)
    SELECT query, dense_max, dense_max >= 0.4 AS passes, CASE WHEN dense_max >= 0.4 THEN 'vector' ELSE 'jaccard (low ' || printf('%.2f', dense_max) || ')' END AS tag FROM g""")
def dense_gate(spark: SparkSession, d: str) -> DataFrame:
    q, rows = _split(spark, d)
    best = vectors.top_k(q, rows, "vec_id", "embedding", 1)
    passes = F.col("cosine") >= 0.4
    return best.select("query", F.col("cosine").alias("dense_max"), passes.alias("passes"), F.when(passes, "vector").otherwise(F.format_string("jaccard (low %.2f)", "cosine")).alias("tag"))


@query(f"""WITH {_PAIRS}, r AS (SELECT query, label, id, cosine, row_number() OVER (PARTITION BY query, label ORDER BY cosine DESC, id) AS rank FROM s)
    SELECT query, label, id, cosine, rank FROM r WHERE rank <= 3""")
def topk_per_entity(spark: SparkSession, d: str) -> DataFrame:
    q, rows = _split(spark, d)
    scored = vectors.similarities(q, rows, "vec_id", "embedding", "label", 3, each_group=True).withColumnRenamed("group", "label")
    return lexical.top_by_group(scored, ["query", "label"], [F.col("cosine").desc(), F.col("id")], 3)


@query(f"""WITH {_PAIRS}, a AS (SELECT query, id, cosine AS score, 0 AS ord FROM s WHERE label < 6 QUALIFY row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) <= 8),
    b AS (SELECT query, id, round(cosine * 0.9::DOUBLE, 6) AS score, 1 AS ord FROM s WHERE label > 3 QUALIFY row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) <= 8),
    o AS (SELECT * FROM (FROM a UNION ALL FROM b) QUALIFY row_number() OVER (PARTITION BY query, id ORDER BY ord DESC) = 1)
    SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM o QUALIFY rank <= 10""")
def cross_domain_pool(spark: SparkSession, d: str) -> DataFrame:
    """Questions to two overlapping domains: the best eight of each are one pool, in
    which what both hold counts as the second domain scores it."""
    q, rows = _split(spark, d)
    found = [vectors.top_k(q, rows.where(part), "vec_id", "embedding", 8, exclude_self=False).select("query", "id", score.alias("score"), F.lit(n).alias("ord")) for n, (part, score) in enumerate((("label < 6", F.col("cosine")), ("label > 3", F.round(F.col("cosine") * 0.9, 6))))]
    return export.merge_pools(found[0].unionByName(found[1]), ["query"], "ord", 10).select("query", "id", "score", "rank")


@query(f"""WITH {_PAIRS}, h AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS rank FROM s WHERE query <> id),
    g AS (SELECT q.vec_id AS query, v.vec_id AS id, 1 + v.vec_id % 3 AS grade FROM v q JOIN v ON q.label = v.label AND q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
    t AS (SELECT query, count(*) AS hits, sum((2 ** grade - 1) / log2(rank + 1)) AS dcg, min(rank) AS first FROM h JOIN g USING (query, id) WHERE rank <= 10 GROUP BY query),
    i AS (SELECT query, count(*) AS labels, sum(CASE WHEN r <= 10 THEN (2 ** grade - 1) / log2(r + 1) END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, id) AS r FROM g) GROUP BY query)
    SELECT query, round(coalesce(hits, 0) / least(10, labels), 6) AS recall, round(CASE WHEN ideal = 0 THEN 0 ELSE coalesce(dcg, 0) / ideal END, 6) AS ndcg, round(coalesce(1 / first, 0), 6) AS mrr FROM i LEFT JOIN t USING (query)""")
def recall_ndcg_mrr(spark: SparkSession, d: str) -> DataFrame:
    q, rows = _split(spark, d)
    ranked = vectors.top_k(q, rows, "vec_id", "embedding", 10)
    gold = q.select(F.col("vec_id").alias("query"), "label").join(rows.select(F.col("vec_id").alias("id"), "label"), "label").where("query <> id").select("query", "id", (1 + F.col("id") % 3).alias("grade"))
    return ranking.gold_metrics(ranked, gold, "query", "id", 10)


@query(f"""WITH {_PAIRS}, a AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS rank FROM s WHERE query <> id),
    b AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id DESC) AS rank FROM s WHERE query <> id AND label <> 0)
    SELECT query, round(count(b.id) / 10, 6) AS overlap FROM (SELECT * FROM a WHERE rank <= 10) a LEFT JOIN (SELECT * FROM b WHERE rank <= 10) b USING (query, id) GROUP BY query""")
def overlap_at_k(spark: SparkSession, d: str) -> DataFrame:
    q, rows = _split(spark, d)
    # Ten rows beside the query's own; ties stay in, so either order of ids can be taken.
    best = lambda rows: vectors.similarities(q, rows, "vec_id", "embedding", limit=11).where("query <> id")
    w = Window.partitionBy("query")
    a = best(rows).withColumn("rank", F.row_number().over(w.orderBy(F.col("cosine").desc(), "id")))
    b = best(rows.where("label <> 0")).withColumn("rank", F.row_number().over(w.orderBy(F.col("cosine").desc(), F.col("id").desc())))
    return ranking.overlap_ratio(a, b, ["query"], "id", 10)


@query(f"""WITH {_PAIRS}, h AS (SELECT query, label, id, cosine, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS rank FROM s WHERE query <> id),
    t AS (SELECT query % 3 AS variant, avg(cosine) AS m, bool_and(cosine > 0) AS all_ok, bool_or(label = 0) AS any_boilerplate, string_agg(DISTINCT 'l' || label, ', ' ORDER BY 'l' || label) AS reasons FROM h WHERE rank = 1 GROUP BY ALL)
    SELECT variant, round(m, 6) AS recall, round(m, 6) AS ndcg, round(m, 6) AS mrr, all_ok, any_boilerplate, reasons FROM t""")
def variant_matrix(spark: SparkSession, d: str) -> DataFrame:
    q, rows = _split(spark, d)
    best = vectors.top_k(q, rows, "vec_id", "embedding", 1).join(rows.select(F.col("vec_id").alias("id"), "label"), "id")
    results = best.select((F.col("query") % 3).alias("variant"), F.col("cosine").alias("recall"), F.col("cosine").alias("ndcg"), F.col("cosine").alias("mrr"), (F.col("cosine") > 0).alias("ok"), (F.col("label") == 0).alias("boilerplate"), F.concat(F.lit("l"), "label").alias("reason"))
    return ranking.variant_matrix(results, ["variant"])


@query()
def rerank_guarded(spark: SparkSession, d: str) -> DataFrame:
    """Guarded reranking of each query's 30 best vectors, a label as the page."""
    q, rows = _split(spark, d)
    ranked = vectors.top_k(q, rows, "vec_id", "embedding", 30).join(rows.select(F.col("vec_id").alias("id"), F.col("label").alias("article")), "id")
    scored = ranked.withColumns({"base_score": F.col("cosine"), "rerank_score": F.when(F.col("id") % 5 != 0, (F.col("id") * 7919 % 101) / 100)})
    return ranking.guarded_rerank(scored, ["query"], "article", "base_score", "rerank_score", 8).select("query", "id", "article", "rank", "place")
