"""Queries that choose rows under constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.operators import export, selection
from lorekeep.plans.registry import query
from lorekeep.storage import load


@query("""WITH s AS (SELECT o_orderkey % 300 AS q, o_custkey % 7 AS page, o_orderkey AS position, (o_orderkey * 31 % 17)::DOUBLE AS score, o_orderpriority || (o_orderkey % 11) AS body, (o_orderkey % 90 + 10)::BIGINT AS cost FROM orders),
    k AS (SELECT *, row_number() OVER (PARTITION BY q, lower(body) ORDER BY (page = 3) DESC, score DESC, page, position) AS r FROM s),
    n AS (SELECT *, (row_number() OVER (PARTITION BY q, page ORDER BY score DESC, position) - CASE WHEN page = 3 THEN 1 ELSE 0 END)::INT AS round FROM k WHERE r = 1),
    g AS (SELECT q, list({'used': 0::BIGINT, 'out': []::BOOLEAN[], 'cost': cost} ORDER BY round, -score, page, position) AS u, list({'page': page, 'position': position, 'round': round, 'cost': cost} ORDER BY round, -score, page, position) AS v FROM n GROUP BY q),
    f AS (SELECT q, v, list_reduce(list_prepend({'used': 0::BIGINT, 'out': []::BOOLEAN[], 'cost': 0::BIGINT}, u), lambda s, x: {'used': CASE WHEN s.used + x.cost <= 400 THEN s.used + x.cost ELSE s.used END, 'out': list_append(s.out, s.used + x.cost <= 400), 'cost': x.cost}).out AS o FROM g),
    e AS (SELECT q, unnest(v) AS v, unnest(o) AS kept FROM f)
    SELECT q, v.page AS page, v.position AS position, v.round AS round, v.cost AS cost, kept FROM e""")
def entity_context(spark: SparkSession, d: str) -> DataFrame:
    """Sections of seven pages for each of 300 entities; page 3 is the target."""
    sections = load(spark, d, "orders").select(
        (F.col("o_orderkey") % 300).alias("q"),
        (F.col("o_custkey") % 7).alias("page"),
        F.col("o_orderkey").alias("position"),
        (F.col("o_orderkey") * 31 % 17).cast("double").alias("score"),
        F.concat("o_orderpriority", (F.col("o_orderkey") % 11).cast("string")).alias("body"),
        (F.col("o_orderkey") % 90 + 10).alias("size"),
    )
    out = selection.entity_context(sections, ["q"], "page", "position", "score", "body", "size", 400, F.col("page") == 3)
    return out.select("q", "page", "position", "round", "cost", "kept")


@query("""WITH RECURSIVE i AS (SELECT l_orderkey AS k, list((l_quantity * 3)::BIGINT ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS c FROM lineitem GROUP BY l_orderkey),
    p AS (SELECT k, c, 0::BIGINT AS low, len(c)::BIGINT AS high FROM i UNION ALL
      SELECT k, c, CASE WHEN h = 0 THEN low ELSE (low + high + 1) // 2 END, CASE WHEN h = 0 THEN (low + high + 1) // 2 ELSE high END
      FROM p, (VALUES (0), (1)) t(h) WHERE high - low > 1 AND list_sum(c[low + 1 : high]) + 5 > 150)
    SELECT k, low::INT AS low, high::INT AS high, (list_sum(c[low + 1 : high]) + 5)::BIGINT AS cost FROM p WHERE NOT (high - low > 1 AND list_sum(c[low + 1 : high]) + 5 > 150)""")
def halved_parts(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose lines exceed a budget are halved until each part fits."""
    unit = F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") * 3).cast("long").alias("c"))
    items = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.sort_array(F.collect_list(unit)), lambda x: x["c"]).alias("c"))
    return selection.halved(items, ["k"], "c", 150, 5)


@query("""SELECT p_brand AS brand, max(p_size) AS budget FROM part WHERE p_size >= 5 AND p_size <= 20 + length(p_brand) GROUP BY p_brand""")
def largest_feasible_budget(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.col("p_size") < 5, "too small").when(F.col("p_size") > 20 + F.length("p_brand"), "too large").otherwise("feasible")
    return selection.largest_feasible(load(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("budget"), verdict.alias("verdict")), ["brand"], "budget", "verdict")


@query()
def fixed_slots(spark: SparkSession, d: str) -> DataFrame:
    """The fused top of each question over four rankings of 30 candidates."""
    pick = lambda m, n: F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: (i * m + F.col("item_id") * n) % 30)
    lists = load(spark, d, "benchmark").select("item_id", pick(7, 1).alias("fused"), pick(11, 3).alias("pages"), pick(13, 5).alias("chunks"), pick(17, 2).alias("legacy"))
    return selection.fixed_slots(lists, ["item_id"], 8)


@query("""WITH s AS (SELECT doc_id, source, md5(coalesce(text, '')) AS digest FROM documents)
    SELECT doc_id, source, digest FROM s WHERE doc_id % 3 = 0 AND doc_id % 5 <> 0""")
def replace_authorities(spark: SparkSession, d: str) -> DataFrame:
    """Every third section was submitted; the text of every fifth has changed since."""
    now = load(spark, d, "documents").select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    items = now.where("doc_id % 3 = 0").withColumn("digest", F.when(F.col("doc_id") % 5 == 0, "changed").otherwise(F.col("digest")))
    return selection.replace_authorities(items, now, ["doc_id", "source", "digest"])


@query("""WITH o AS (SELECT conv_id * 1000 + turn AS id, role AS kind, conv_id * 1000 + turn AS position FROM conversations WHERE role <> 'user'),
    p AS (SELECT page_id AS id, 'user' AS kind, NULL::BIGINT AS position FROM pages), b AS (SELECT * FROM o UNION ALL SELECT * FROM p)
    SELECT id, kind, row_number() OVER (ORDER BY position IS NULL, position, id) AS place FROM b""")
def replaced_pages(spark: SparkSession, d: str) -> DataFrame:
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("id")
    records = load(spark, d, "conversations").select(key, F.col("role").alias("kind")).withColumn("position", F.col("id"))
    pages = load(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit("user").alias("kind"))
    out = selection.replace_pages(records, pages, F.col("kind") == "user", "id")
    # A result of this size is numbered in one task only to compare its order.
    return out.select("id", "kind", F.row_number().over(Window.orderBy("place")).cast("long").alias("place"))


@query(r"""WITH u AS (SELECT page_id, unnest(list_distinct(list_transform(regexp_extract_all(concat_ws(' ', html, url), 'https?://[^\s<>"''`\])}]+'), lambda u: regexp_replace(u, '[.,;:!?]+$', '')))) AS url FROM pages)
    SELECT page_id AS k, url FROM u EXCEPT SELECT page_id + 1 AS k, url FROM u""")
def foreign_urls(spark: SparkSession, d: str) -> DataFrame:
    """URLs of a page that the page before it, its source, does not hold."""
    pages = load(spark, d, "pages").select("page_id", F.concat_ws(" ", "html", "url").alias("text"))
    return selection.foreign_urls(pages.select(F.col("page_id").alias("k"), "text"), pages.select((F.col("page_id") + 1).alias("k"), "text"), "k")


@query("""WITH v AS (SELECT event_type AS variant, quantile_disc(value, 0.95) AS p95, round(avg(event_id % 100) / 100, 6) AS quality FROM events GROUP BY event_type)
    SELECT *, p95 <= 150 AND quality >= 0.3 AS accepted FROM v""")
def latency_verdict(spark: SparkSession, d: str) -> DataFrame:
    runs = load(spark, d, "events").select(F.col("event_type").alias("variant"), "value", ((F.col("event_id") % 100) / 100).alias("quality"))
    return selection.latency_verdict(runs, "variant", "value", "quality", 150.0, 0.3)


@query(r"""WITH t AS (SELECT p_partkey AS k, list_transform(['#' || p_brand, ' /' || p_type || '/', upper(p_brand), '', p_type || '/x'],
      lambda t: replace(regexp_replace(lower(regexp_replace(regexp_replace(trim(t), '^#+', ''), '^/+|/+$', '', 'g')), '[\s_]+', '-', 'g'), '/', '-')) AS t FROM part)
    SELECT k, (SELECT string_agg(x, ',' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(t) AS x, unnest(range(len(t))) AS i) WHERE x <> '' GROUP BY x)) AS tags FROM t""")
def export_tags(spark: SparkSession, d: str) -> DataFrame:
    raw = F.array(F.concat(F.lit("#"), "p_brand"), F.concat(F.lit(" /"), "p_type", F.lit("/")), F.upper("p_brand"), F.lit(""), F.concat("p_type", F.lit("/x")))
    return load(spark, d, "part").select(F.col("p_partkey").alias("k"), F.array_join(selection.export_tags(raw), ",").alias("tags"))


@query("""SELECT page_id, url AS token FROM pages""")
def source_tokens(spark: SparkSession, d: str) -> DataFrame:
    """List entries written with spaces and quotes around them."""
    quote = F.when(F.col("page_id") % 2 == 0, '"').otherwise("'")
    return load(spark, d, "pages").select("page_id", selection.source_token(F.concat(F.lit(" \t"), quote, F.lit(" "), "url", quote, F.lit("\n"))).alias("token"))


@query("""SELECT label AS page, count(*) AS n, round(sum(embedding[1]), 4) AS first FROM embeddings WHERE vec_id % 3 = 0 GROUP BY label""")
def summary_vectors(spark: SparkSession, d: str) -> DataFrame:
    kinds = load(spark, d, "embeddings").select(F.col("label").alias("page"), F.when(F.col("vec_id") % 3 == 0, "summary").otherwise("body").alias("kind"), F.col("embedding").alias("vector"))
    return selection.summary_vectors(kinds, "page").groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("vector")[0].cast("double")), 4).alias("first"))


@query("""WITH e AS (SELECT event_id, user_id % 12 + 1 AS attempt, CASE WHEN event_id % 4 = 0 THEN (event_id * 37 % 20000)::DOUBLE END AS header, (event_id % 100) / 100::DOUBLE AS jitter FROM events)
    SELECT event_id, CASE WHEN header IS NOT NULL THEN least(header, 8000) ELSE round(least(8000, 500 * 2.0::DOUBLE ** (attempt - 1)) * (0.75::DOUBLE + 0.25::DOUBLE * jitter)) END::DOUBLE AS delay FROM e""")
def retry_delays(spark: SparkSession, d: str) -> DataFrame:
    header = F.when(F.col("event_id") % 4 == 0, (F.col("event_id") * 37 % 20000).cast("double"))
    return load(spark, d, "events").select("event_id", export.retry_delay(F.col("user_id") % 12 + 1, header, (F.col("event_id") % 100) / 100).alias("delay"))
