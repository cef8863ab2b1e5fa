"""Queries that choose and pack context, and histories of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import context, lexical, maintenance
from lorekeep.plans import indexes
from lorekeep.plans.registry import query
from lorekeep.storage import load

_FOLD = """list_reduce(list_prepend({'used': 0::BIGINT, 'out': []::STRUCT(id BIGINT, cost BIGINT, kept BOOLEAN, used BIGINT)[], 'id': 0::BIGINT, 'cost': 0::BIGINT}, list_transform(u, lambda x: {'used': 0::BIGINT, 'out': []::STRUCT(id BIGINT, cost BIGINT, kept BOOLEAN, used BIGINT)[], 'id': x.id, 'cost': x.cost})),
    lambda s, x: {'used': CASE WHEN s.used + x.cost <= BUDGET THEN s.used + x.cost ELSE s.used END,
      'out': list_append(s.out, {'id': x.id, 'cost': x.cost, 'kept': s.used + x.cost <= BUDGET, 'used': CASE WHEN s.used + x.cost <= BUDGET THEN s.used + x.cost ELSE s.used END}), 'id': x.id, 'cost': x.cost})"""


@query(f"""WITH g AS (SELECT item_id, list({{'id': k, 'cost': c}} ORDER BY k) AS u FROM (SELECT item_id, i AS k, (length(text) * (i + 3) % 700 + 20)::BIGINT AS c FROM benchmark, range(1, 41) r(i)) GROUP BY item_id),
    o AS (SELECT item_id, unnest(({_FOLD.replace("BUDGET", "3000")}).out) AS p FROM g) SELECT item_id, p.id AS unit, p.cost AS cost, p.kept AS kept, p.used AS used FROM o""")
def pack_context(spark: SparkSession, d: str) -> DataFrame:
    """Greedy packing with skips of 40 candidate units a question."""
    units = load(spark, d, "benchmark").select("item_id", F.length("text").alias("n"), F.explode(F.sequence(F.lit(1), F.lit(40))).alias("k"))
    units = units.select("item_id", F.col("k").cast("long").alias("unit"), (F.col("n") * (F.col("k") + 3) % 700 + 20).cast("long").alias("c"), F.col("k").alias("priority"))
    return context.greedy_pack(units, ["item_id"], "unit", "c", 3000, ["priority"])


@query("""WITH u AS (SELECT item_id, k AS unit, (length(text) * (k + 3) % 700 + 20)::BIGINT AS cost FROM benchmark, range(1, 41) r(k)),
    g AS (SELECT item_id, list({'used': 0::BIGINT, 'batch': 0, 'out': []::STRUCT(id BIGINT, batch INT)[], 'id': unit, 'cost': cost} ORDER BY unit) AS u FROM u GROUP BY item_id),
    o AS (SELECT item_id, unnest(list_reduce(list_prepend({'used': 0::BIGINT, 'batch': 0, 'out': []::STRUCT(id BIGINT, batch INT)[], 'id': 0::BIGINT, 'cost': 0::BIGINT}, u),
      lambda s, x: {'used': CASE WHEN s.used > 0 AND s.used + x.cost > 1500 THEN x.cost ELSE s.used + x.cost END, 'batch': s.batch + CASE WHEN s.used > 0 AND s.used + x.cost > 1500 THEN 1 ELSE 0 END,
        'out': list_append(s.out, {'id': x.id, 'batch': s.batch + CASE WHEN s.used > 0 AND s.used + x.cost > 1500 THEN 1 ELSE 0 END}), 'id': x.id, 'cost': x.cost}).out) AS p FROM g)
    SELECT item_id, p.id AS unit, p.batch AS batch FROM o""")
def next_fit_batches(spark: SparkSession, d: str) -> DataFrame:
    units = load(spark, d, "benchmark").select("item_id", F.length("text").alias("n"), F.explode(F.sequence(F.lit(1), F.lit(40))).alias("k"))
    units = units.select("item_id", F.col("k").cast("long").alias("unit"), (F.col("n") * (F.col("k") + 3) % 700 + 20).cast("long").alias("c"), F.col("k").alias("priority"))
    return context.next_fit(units, ["item_id"], "unit", "c", 1500, ["priority"]).select("item_id", "unit", "batch")


@query("""WITH r AS (SELECT lang, source AS article, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
    c AS (SELECT *, least(24, count(*) OVER (PARTITION BY lang)) AS n, row_number() OVER (PARTITION BY lang, article ORDER BY rank) = 1 AS f FROM r),
    a AS (SELECT *, sum(f::INT) OVER (PARTITION BY lang ORDER BY rank) AS a FROM c)
    SELECT lang, doc_id, rank, f AND a <= n - n // 3 AS anchor FROM a""")
def context_anchors(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("lang").orderBy(F.col("n_chars").desc(), "doc_id")
    ranked = load(spark, d, "documents").select("lang", F.col("source").alias("article"), "doc_id", F.row_number().over(w).alias("rank"))
    return context.anchors(ranked, ["lang"], "article", 24).select("lang", "doc_id", "rank", "anchor")


_HIST = """t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
    c AS (SELECT *, max(CASE WHEN role = 'user' THEN i END) OVER (PARTITION BY conv_id) AS c FROM t),
    u AS (SELECT *, CASE WHEN i < c THEN i - CASE WHEN coalesce(role = 'assistant' AND before = 'user', false) THEN 1 ELSE 0 END END AS unit FROM c)"""


@query(f"WITH {_HIST} SELECT conv_id, turn, role, unit::BIGINT AS unit, coalesce(i = c, false) AS current FROM u")
def history_pairs(spark: SparkSession, d: str) -> DataFrame:
    return context.history_units(load(spark, d, "conversations")).select("conv_id", "turn", "role", "unit", "current")


@query()
def chat_budget(spark: SparkSession, d: str) -> DataFrame:
    return context.pack_history(load(spark, d, "conversations"), 600)


@query("""WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM documents) SELECT lang, doc_id, (i // 64)::INT AS batch FROM r""")
def fixed_batches(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("lang", "doc_id")
    return maintenance.fixed_batches(docs, ["lang"], ["doc_id"], 64)


@query("""WITH n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
    SELECT source, doc_id, greatest(0, n - 20) AS overflow FROM n WHERE r <= 20""")
def capped_lists(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the first 20 documents of a source and how many are left out."""
    return maintenance.capped(load(spark, d, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 20)


@query("""SELECT b AS budget, p AS prompt, m AS most, CASE WHEN b <= 1 THEN b ELSE greatest(1, least(b - 1, CASE WHEN p > 0 AND m > 0 AND m < p THEN floor(b * m / p * 0.9::DOUBLE) ELSE floor(b * 0.75::DOUBLE) END)) END::BIGINT AS next
    FROM (SELECT n_chars AS b, doc_id AS p, (doc_id * 7 % 500)::BIGINT AS m FROM documents)""")
def shrunk_budgets(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select(F.col("n_chars").alias("budget"), F.col("doc_id").alias("prompt"), (F.col("doc_id") * 7 % 500).alias("most"))
    return rows.withColumn("next", context.shrink_budget(F.col("budget"), F.col("prompt"), F.col("most")).cast("long"))


def _candidates(spark: SparkSession, d: str, limit: int) -> DataFrame:
    """Ranked line chunks of each question with the question's text."""
    questions = load(spark, d, "benchmark")
    ranked = lexical.search_chunks(questions, indexes.chunk_index(spark, d), "item_id", limit)
    chunks = indexes.line_chunks(spark, d)
    texts = ranked.join(chunks.select("article_id", "ordinal", "body"), ["article_id", "ordinal"])
    return texts.join(questions.select("item_id", F.col("text").alias("question")), "item_id")


@query()
def query_pipeline_context(spark: SparkSession, d: str) -> DataFrame:
    """Question to packed context: lexical chunks, exact dedup, anchors, facets
    and siblings, then greedy packing after the question is paid for."""
    ranked = _candidates(spark, d, 30)
    unique = context.dedupe_chunks(ranked, ["item_id"], "score", "rank")
    chosen = context.select_context(unique.select("item_id", "article_id", "ordinal", "heading", "body", "score", "rank", "question"), ["item_id"], "article_id", "question", 8)
    units = chosen.select("item_id", "article_id", "ordinal", "place", F.col("place").cast("long").alias("unit"), T.estimate_tokens(F.col("body")).alias("c"))
    paid = load(spark, d, "benchmark").select("item_id", T.estimate_tokens(F.col("text")).alias("cost"))
    packed = context.pack_context(paid, units, ["item_id"], "unit", "c", 400, ["place"])
    return units.join(packed.select("item_id", "unit", "cost", "kept"), ["item_id", "unit"]).select("item_id", "article_id", "ordinal", "place", "cost", "kept")
