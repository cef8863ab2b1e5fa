"""Queries over link graphs: the pages' links, and parts with their suppliers as
a graph whose nodes are all known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import graph, ranking
from lorekeep.plans.registry import query
from lorekeep.storage import dealt, load

_PAGE = r"regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*/', '')"
_EDGES = rf"""e AS (SELECT DISTINCT src, dst FROM (SELECT {_PAGE} AS src, unnest(list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda h: trim(regexp_replace(h, '^.*/', '')))) AS dst FROM pages) WHERE dst <> ''),
    n AS (SELECT DISTINCT {_PAGE} AS id FROM pages)"""
_PARTS = "e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem), n AS (SELECT p_partkey AS id FROM part)"


def _pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = load(spark, d, "pages").withColumn("id", F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^.*/", ""))
    return pages.select("id").distinct(), graph.link_edges(pages, "id", "html", graph.HREF, lambda h: F.trim(F.regexp_replace(h, "^.*/", "")))


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = load(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    edges = dealt(lines, lines.count(), "src", "dst").distinct()
    return load(spark, d, "part").select(F.col("p_partkey").alias("id")), edges


@query(f"WITH {_EDGES} SELECT src, dst FROM e")
def link_edges(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d)[1]


@query(f"WITH {_EDGES}, c AS (SELECT dst AS id, count(*) AS c FROM e GROUP BY dst) SELECT id, coalesce(c, 0)::BIGINT AS in_degree FROM n FULL JOIN c USING (id)")
def in_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.in_degree(*_pages(spark, d))


@query(f"WITH {_PARTS}, c AS (SELECT dst AS id, count(*) AS c FROM e GROUP BY dst) SELECT id, coalesce(c, 0)::BIGINT AS in_degree FROM n FULL JOIN c USING (id)")
def in_degree_parts(spark: SparkSession, d: str) -> DataFrame:
    return graph.in_degree(*_parts(spark, d))


@query(f"WITH {_PARTS} SELECT id FROM n WHERE id NOT IN (SELECT src FROM e) AND id NOT IN (SELECT dst FROM e)")
def isolated_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.isolated(*_parts(spark, d))


@query(f"WITH {_PARTS} SELECT src, dst FROM e WHERE dst IN (SELECT id FROM n) AND (dst, src) NOT IN (SELECT (src, dst) FROM e)")
def unreciprocated_links(spark: SparkSession, d: str) -> DataFrame:
    return graph.unreciprocated(*_parts(spark, d))


@query(f"""WITH {_PARTS} SELECT id, 'isolated node (no links in or out)' AS issue FROM n WHERE id NOT IN (SELECT src FROM e) AND id NOT IN (SELECT dst FROM e)
    UNION ALL SELECT src, '→ [[' || dst || ']] not reciprocated' FROM e WHERE dst IN (SELECT id FROM n) AND (dst, src) NOT IN (SELECT (src, dst) FROM e)""")
def graph_structure(spark: SparkSession, d: str) -> DataFrame:
    return graph.structure_issues(*_parts(spark, d))


_BFS = """s AS (SELECT DISTINCT l_partkey AS seed FROM lineitem WHERE l_partkey % 100 = 0),
    st AS (SELECT src AS a, dst AS b FROM e WHERE dst IN (SELECT id FROM n) UNION SELECT dst, src FROM e),
    h0 AS (SELECT seed, seed AS id, 0 AS hop FROM s),
    h1 AS (SELECT DISTINCT seed, b AS id, 1 AS hop FROM h0 JOIN st ON id = a WHERE (seed, b) NOT IN (SELECT (seed, id) FROM h0)),
    v1 AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1),
    h2 AS (SELECT DISTINCT seed, b AS id, 2 AS hop FROM h1 JOIN st ON id = a WHERE (seed, b) NOT IN (SELECT (seed, id) FROM v1)),
    v2 AS (SELECT * FROM v1 UNION ALL SELECT * FROM h2)"""


@query(f"WITH {_PARTS}, {_BFS} SELECT seed, id, hop FROM v2")
def bfs_hops(spark: SparkSession, d: str) -> DataFrame:
    """Two hops from every hundredth part, each seed a query of its own."""
    nodes, edges = _parts(spark, d)
    seeds = edges.select(F.col("src").alias("seed"), F.col("src").alias("id")).where("seed % 100 = 0").distinct()
    return graph.bfs(seeds, nodes, edges, 2, ["seed"])


@query(f"""WITH {_PARTS}, {_BFS}, g AS (SELECT dst AS id, count(*) AS degree FROM e GROUP BY dst),
    c AS (SELECT v.seed, v.id, v.hop, coalesce(g.degree, 0) AS degree, (v.id * 7919 % 1009) / 1009 AS score FROM v1 v LEFT JOIN g USING (id)),
    l AS (SELECT seed, id, 0 AS n, row_number() OVER (PARTITION BY seed ORDER BY score DESC, id) AS rank FROM c UNION ALL
          SELECT seed, id, 1, row_number() OVER (PARTITION BY seed ORDER BY hop, degree DESC, id) FROM c),
    r AS (SELECT seed, id, round(sum(1 / (60 + rank)), 9) AS score, min(n * 1000000 + rank) AS first FROM l GROUP BY ALL)
    SELECT seed, id, score, row_number() OVER (PARTITION BY seed ORDER BY score DESC, first) AS rank FROM r""")
def fuse_vector_graph(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _parts(spark, d)
    seeds = edges.select(F.col("src").alias("seed"), F.col("src").alias("id")).where("seed % 100 = 0").distinct()
    reached = graph.bfs(seeds, nodes, edges, 1, ["seed"])
    degree = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    candidates = reached.join(degree, "id", "left").withColumns({"score": (F.col("id") * 7919 % 1009) / 1009, "pos": F.col("id")})
    return ranking.fuse_vector_graph(candidates, ["seed"])


@query(f"""WITH {_PARTS}, {_BFS}, r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY (id * 7919 % 1009) / 1009 DESC, id) AS r FROM h1)
    SELECT seed, id, hop FROM h0 UNION ALL SELECT seed, id, hop FROM r WHERE r <= 3""")
def bfs_ranked(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _parts(spark, d)
    seeds = edges.select(F.col("src").alias("seed"), F.col("src").alias("id")).where("seed % 100 = 0").distinct()
    reached = graph.bfs(seeds, nodes, edges, 1, ["seed"])
    scores = reached.select("seed", "id", ((F.col("id") * 7919 % 1009) / 1009).alias("score"))
    return graph.bfs_ranked(reached, scores, ["seed"], 3)


@query(f"WITH {_EDGES} SELECT DISTINCT dst AS id FROM e WHERE dst NOT IN (SELECT id FROM n)")
def broken_links(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _pages(spark, d)
    return graph.broken_links(edges, nodes)


@query(f"WITH {_EDGES} SELECT src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM (SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '') AS p FROM pages) WHERE suffix(p || '.md', dst || '.md'))")
def dead_links(spark: SparkSession, d: str) -> DataFrame:
    edges = _pages(spark, d)[1]
    paths = load(spark, d, "pages").select(F.concat(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", ""), F.lit(".md")).alias("path"))
    return graph.dead_links_by_suffix(edges, paths)


@query(rf"""WITH i AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS identity, page_id AS path FROM pages UNION ALL SELECT {_PAGE}, page_id FROM pages)
    SELECT identity, list_sort(list(DISTINCT path)) AS paths FROM i GROUP BY identity HAVING count(DISTINCT path) > 1""")
def alias_conflicts(spark: SparkSession, d: str) -> DataFrame:
    pages = load(spark, d, "pages")
    hosts = pages.select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("identity"), F.col("page_id").alias("path"))
    names = pages.select(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^.*/", "").alias("identity"), F.col("page_id").alias("path"))
    return graph.alias_conflicts(hosts.unionByName(names))


@query(rf"""WITH i AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS identity, page_id AS path FROM pages UNION ALL SELECT {_PAGE}, page_id FROM pages)
    SELECT identity, min(path) AS path FROM i GROUP BY identity HAVING count(DISTINCT path) = 1""")
def canonical_identities(spark: SparkSession, d: str) -> DataFrame:
    pages = load(spark, d, "pages")
    hosts = pages.select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("identity"), F.col("page_id").alias("path"))
    names = pages.select(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^.*/", "").alias("identity"), F.col("page_id").alias("path"))
    return graph.unique_owners(hosts.unionByName(names), F.col("identity"), F.col("path"))


@query(r"""WITH b AS (SELECT p_name AS broken, lower(regexp_extract(p_name, '(?i)([a-z]{1,8})?[-_ ]?([0-9]{2,})', 1)) AS p, regexp_extract(p_name, '(?i)([a-z]{1,8})?[-_ ]?([0-9]{2,})', 2) AS d FROM part),
    c AS (SELECT 'wiki_' || c_name AS stem, c_custkey AS pos, lower(regexp_extract('wiki_' || c_name, '(?i)([a-z]{1,8})?[-_ ]?([0-9]{2,})', 1)) AS p, regexp_extract('wiki_' || c_name, '(?i)([a-z]{1,8})?[-_ ]?([0-9]{2,})', 2) AS d FROM customer),
    f AS (SELECT b.broken, count(DISTINCT c.p || c.d) AS n, arg_min(stem, pos) AS stem FROM b JOIN c ON b.d <> '' AND c.d <> '' AND contains(c.d, b.d) AND (b.p = '' OR b.p = c.p) GROUP BY b.broken)
    SELECT b.broken, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS kind, CASE WHEN n = 1 THEN f.stem END AS stem FROM b LEFT JOIN f USING (broken)""")
def resolve_links(spark: SparkSession, d: str) -> DataFrame:
    """Part names as broken stems against customer stems."""
    broken = load(spark, d, "part").select(F.col("p_name").alias("stem"))
    candidates = load(spark, d, "customer").select(F.concat(F.lit("wiki_"), "c_name").alias("stem"), F.col("c_custkey").alias("pos"))
    return graph.resolve_ids(broken, candidates)
