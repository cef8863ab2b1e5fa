"""Queries on changes, deletions, upserts, coverage and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import maintenance as M
from lorekeep.plans.registry import query
from lorekeep.storage import load

_CUR = "c AS (SELECT source || '/' || doc_id || '.md' AS path, md5(coalesce(text, '')) AS hash, doc_id FROM documents)"
_OLD = "o AS (SELECT path, CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 7 = 0 THEN 'stale' ELSE hash END AS hash FROM c WHERE doc_id % 5 <> 0)"


def _current(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.md5(T.text_or_empty(F.col("text"))).alias("hash"), "doc_id")


@query(f"WITH {_CUR}, {_OLD} SELECT path, c.hash AS hash, CASE WHEN o.path IS NULL THEN 'new' WHEN o.hash = '' THEN 'baseline' WHEN o.hash <> c.hash THEN 'changed' ELSE 'same' END AS status FROM c LEFT JOIN o USING (path)")
def changed_sources(spark: SparkSession, d: str) -> DataFrame:
    """Against a stored state that lacks, blanks or ages some of the hashes."""
    current = _current(spark, d)
    stored = current.where("doc_id % 5 <> 0").select("path", F.when(F.col("doc_id") % 11 == 0, "").when(F.col("doc_id") % 7 == 0, "stale").otherwise(F.col("hash")).alias("hash"))
    return M.changed_sources(current, stored)


_PLAN = """p AS (SELECT o_orderkey AS path, list(DISTINCT 's' || l_suppkey) AS resource FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey),
    x AS (SELECT 'src/s' || s_suppkey || '.md' AS source, 's' || s_suppkey AS stem FROM supplier WHERE s_nationkey = 1),
    h AS (SELECT source, path, resource, stem FROM p JOIN x ON list_contains(resource, stem))"""


def _deletion(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    pages = lines.groupBy(F.col("l_orderkey").alias("path")).agg(F.collect_set(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("resource"))
    stem = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    suppliers = load(spark, d, "supplier").select("s_nationkey", stem.alias("stem"), F.concat(F.lit("src/"), stem, F.lit(".md")).alias("path"))
    deleted = suppliers.where("s_nationkey = 1").select(F.col("path").alias("source"), "stem")
    return M.deletion_plan(pages, deleted, suppliers.select("stem", "path"))


@query(f"WITH {_PLAN} SELECT source, path, CASE WHEN len(resource) = 1 THEN 'delete' ELSE 'rebuild' END AS action FROM h")
def deletion_plan(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pages and their suppliers as sources; one nation's suppliers go."""
    return _deletion(spark, d)[0]


@query(f"WITH {_PLAN}, r AS (SELECT DISTINCT source, stem, unnest(resource) AS t FROM h WHERE len(resource) > 1) SELECT DISTINCT source, 'src/' || t || '.md' AS remaining FROM r WHERE t <> stem")
def remaining_sources(spark: SparkSession, d: str) -> DataFrame:
    return _deletion(spark, d)[1]


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey % 4 <> 0
    UNION ALL SELECT o_orderkey, 'X', o_totalprice + 1 FROM orders WHERE o_custkey % 4 = 0""")
def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    incoming = orders.where("o_custkey % 4 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return M.upsert(orders.drop("o_custkey"), incoming, ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def index_remove(spark: SparkSession, d: str) -> DataFrame:
    gone = load(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return M.remove(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), gone, ["l_orderkey"])


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""")
def last_by_key(spark: SparkSession, d: str) -> DataFrame:
    return M.last_by(load(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_id", "event_type", "value")


@query("""WITH a AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 9 <> 0), b AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 10 <> 0)
    SELECT p_partkey, CASE WHEN a.p_brand IS NULL THEN 'added' WHEN b.p_brand IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b USING (p_partkey)
    WHERE a.p_brand IS NULL OR b.p_brand IS NULL OR a.p_brand <> b.p_brand OR a.p_size <> b.p_size""")
def entity_diff(spark: SparkSession, d: str) -> DataFrame:
    """Between two versions of the parts: each lacks some, and some sizes differ."""
    part = load(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    new = part.where("p_partkey % 10 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return M.version_diff(part.where("p_partkey % 9 <> 0"), new, ["p_partkey"], ["p_brand", "p_size"])


@query("""WITH g AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 AND l_returnflag <> 'R' GROUP BY 1), e AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P')
    SELECT id, CASE WHEN g.n IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'unexpected' ELSE 'twice' END AS problem FROM e FULL JOIN g USING (id) WHERE g.n IS NULL OR e.id IS NULL OR g.n > 1""")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    given = load(spark, d, "lineitem").where("l_linenumber <= 2 AND l_returnflag <> 'R'").select(F.col("l_orderkey").alias("id"))
    return M.coverage_gaps(load(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id")), given, "id")


@query("""WITH r AS (SELECT l_partkey AS k, (l_orderkey % 200 + 1)::BIGINT AS s, (l_orderkey % 200 + 1 + l_linenumber)::BIGINT AS e FROM lineitem), n AS (SELECT p_partkey AS k, 220::BIGINT AS lines FROM part),
    a AS (SELECT k, s, e FROM r UNION ALL SELECT k, lines + 1, lines + 1 FROM n), m AS (SELECT *, coalesce(max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM a)
    SELECT k, reach + 1 AS gap_start, s - 1 AS gap_end FROM m WHERE s > reach + 1""")
def line_gaps(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("l_orderkey") % 200 + 1
    ranges = load(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), start.alias("start"), (start + F.col("l_linenumber")).alias("end"))
    return M.line_gaps(load(spark, d, "part").select(F.col("p_partkey").alias("k"), F.lit(220).cast("long").alias("lines")), ranges, "k")


@query("""WITH i AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS item, l_partkey % 300 AS s, l_partkey % 300 + l_linenumber AS e FROM lineitem WHERE l_returnflag = 'R'),
    b AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS bundle, l_linenumber = 1 AS p, l_orderkey * 10 + l_linenumber AS pos, l_partkey % 300 AS s, l_partkey % 300 + 4 AS e FROM lineitem WHERE l_returnflag = 'A'),
    m AS (SELECT i.k, item, bundle, b.p, pos, sum(least(i.e, b.e) - greatest(i.s, b.s) + 1)::BIGINT AS overlap FROM i JOIN b ON i.k = b.k AND i.s <= b.e AND b.s <= i.e GROUP BY i.k, item, bundle, b.p, pos)
    SELECT k, item, bundle, overlap FROM (SELECT *, row_number() OVER (PARTITION BY k, item ORDER BY overlap DESC, p DESC, pos) AS r FROM m) WHERE r = 1""")
def interval_overlap_assign(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_returnflag", "l_linenumber", (F.col("l_partkey") % 300).alias("start"))
    items = rows.where("l_returnflag = 'R'").select("k", F.col("id").alias("item"), "start", (F.col("start") + F.col("l_linenumber")).alias("end"))
    bundles = rows.where("l_returnflag = 'A'").select("k", F.col("id").alias("bundle"), (F.col("l_linenumber") == 1).alias("primary"), F.col("id").alias("pos"), "start", (F.col("start") + 4).alias("end"))
    return M.overlap_assignment(items, bundles, "k", "item", "bundle")


@query("""WITH p AS (SELECT l_orderkey AS entity, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS pos, ['f' || l_partkey % 5, 'g' || l_suppkey % 3] AS facts FROM lineitem),
    f AS (SELECT entity, fact, min(o) AS o FROM (SELECT entity, unnest(facts) AS fact, pos * 10 + unnest(range(2)) AS o FROM p) GROUP BY ALL)
    SELECT entity, string_agg(fact, ',' ORDER BY o) AS facts FROM f GROUP BY entity""")
def merged_evidence(spark: SparkSession, d: str) -> DataFrame:
    facts = F.array(F.concat(F.lit("f"), (F.col("l_partkey") % 5).cast("string")), F.concat(F.lit("g"), (F.col("l_suppkey") % 3).cast("string")))
    packets = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity"), (F.col("l_linenumber").cast("long") * 10000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("pos"), facts.alias("facts"), F.array("l_partkey").alias("ranges"), F.array("l_suppkey").alias("links"))
    return M.merge_evidence(packets).select("entity", F.array_join("facts", ",").alias("facts"))


@query("""SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(event_type)), user_id ORDER BY event_id) AS r FROM events) WHERE r = 1""")
def merged_findings(spark: SparkSession, d: str) -> DataFrame:
    return M.merge_findings(load(spark, d, "events"), ["event_type", "user_id"], "event_id").select("event_type", "event_id")


@query("""WITH f AS (SELECT DISTINCT source || '/' || lang AS p FROM documents UNION SELECT DISTINCT source FROM documents WHERE doc_id % 2 = 0)
    SELECT p AS path FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE starts_with(f.p, g.p || '/'))""")
def consolidated_folders(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    folders = docs.select(F.concat_ws("/", "source", "lang").alias("path")).unionByName(docs.where("doc_id % 2 = 0").select(F.col("source").alias("path"))).distinct()
    return M.consolidate_prefixes(folders)


@query("""WITH r AS (SELECT source AS root, min(doc_id) AS pos, 'd_' || source AS domain FROM documents WHERE lang = 'en' GROUP BY source)
    SELECT source || '/' || lang || '/' || doc_id AS path, coalesce(domain, 'other') AS domain FROM documents LEFT JOIN r ON source = root""")
def routed_domains(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    roots = docs.where("lang = 'en'").groupBy(F.col("source").alias("root")).agg(F.min("doc_id").alias("pos")).withColumn("domain", F.concat(F.lit("d_"), "root"))
    return M.route_by_prefix(docs.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path")), roots, F.lit("other"))


@query("""SELECT source, round(avg(quality), 6) AS up_rate, count(quality) AS n, round(avg(toxic), 6) AS toxic_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def label_rate_by_source(spark: SparkSession, d: str) -> DataFrame:
    joined = load(spark, d, "documents").select("doc_id", "source").join(load(spark, d, "labels"), "doc_id", "left")
    return joined.groupBy("source").agg(F.round(F.avg("quality"), 6).alias("up_rate"), F.count("quality").alias("n"), F.round(F.avg("toxic"), 6).alias("toxic_rate"))


@query("""WITH g AS (SELECT (doc_id % 50)::BIGINT AS query_id, doc_id, CASE WHEN doc_id % 13 = 0 THEN 4 ELSE 1 + quality + toxic END AS grade FROM labels UNION ALL SELECT (doc_id % 50)::BIGINT, doc_id, 1 FROM labels WHERE doc_id % 17 = 0
      UNION ALL SELECT 0, 10000000 + doc_id, 1 FROM labels WHERE doc_id % 19 = 0),
    q AS (SELECT item_id AS query_id FROM benchmark), k AS (SELECT doc_id FROM documents)
    SELECT DISTINCT query_id, NULL::BIGINT AS doc_id, 'unknown query' AS problem FROM g WHERE query_id NOT IN (SELECT query_id FROM q)
    UNION ALL SELECT query_id, NULL, 'missing labels' FROM q WHERE query_id NOT IN (SELECT query_id FROM g)
    UNION ALL SELECT query_id, doc_id, 'duplicate label' FROM g GROUP BY query_id, doc_id HAVING count(*) > 1
    UNION ALL SELECT query_id, doc_id, 'unknown document' FROM g WHERE doc_id NOT IN (SELECT doc_id FROM k)
    UNION ALL SELECT query_id, doc_id, 'invalid grade' FROM g WHERE grade NOT IN (1, 2, 3)""")
def gold_problems(spark: SparkSession, d: str) -> DataFrame:
    from lorekeep.operators.ranking import gold_problems as problems

    labels, q = load(spark, d, "labels"), (F.col("doc_id") % 50)
    gold = labels.select(q.alias("query_id"), "doc_id", F.when(F.col("doc_id") % 13 == 0, 4).otherwise(1 + F.col("quality") + F.col("toxic")).alias("grade"))
    gold = gold.unionByName(labels.where("doc_id % 17 = 0").select(q.alias("query_id"), "doc_id", F.lit(1).alias("grade")))
    gold = gold.unionByName(labels.where("doc_id % 19 = 0").select(F.lit(0).cast("long").alias("query_id"), (F.col("doc_id") + 10000000).alias("doc_id"), F.lit(1).alias("grade")))
    return problems(gold, load(spark, d, "benchmark").select(F.col("item_id").alias("query_id")), load(spark, d, "documents"), "query_id", "doc_id")
