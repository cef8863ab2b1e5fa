"""Queries over Markdown pages, built from every document's columns and whole
text so that an oracle knows what is in them, and over line ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import markdown as M
from lorekeep.operators import intervals
from lorekeep.plans.registry import query
from lorekeep.storage import load

#: A page with frontmatter, title, links, the document's text and a list of links.
_PARTS = [
    "---\ntype: concept\ndescription: Text in ", "lang", "\ntags: [", "lang", ", source/", "source", ']\naliases:\n  - "d', "doc_id", '"\n---\n# Document ', "doc_id", "\n\nSee [[",
    "lang", "]].\n\n## Text\n", "text", "\n\n## Related\n- [[types/", "source", "|", "source", "]]\n- [[ page ", "doc_id", " ]]\n- [[types/", "lang", "]]\n",
]
_PAGE = "concat(" + ", ".join(f"coalesce({p}::VARCHAR, '')" if i % 2 else f"'{p}'" for i, p in enumerate(_PARTS)) + ")"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(_PARTS)])
    return load(spark, d, "documents").withColumn("page", page)


def _on_page(f, kind: str) -> Column:
    return M.column(f, kind)(F.col("page"))


@query("""SELECT doc_id, 'Document ' || doc_id AS title, 'Text in ' || coalesce(lang, '') AS description, coalesce(lang, '') || '; source/' || coalesce(source, '') AS tags, 'd' || doc_id AS aliases FROM documents""")
def page_fields(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select(
        "doc_id",
        _on_page(lambda c: M.title_of(c, "none"), "string").alias("title"),
        _on_page(lambda c: M.description_of(c), "string").alias("description"),
        _on_page(lambda c: "; ".join(M.tags_of(c)), "string").alias("tags"),
        _on_page(lambda c: "; ".join(M.aliases_of(c)), "string").alias("aliases"),
    )


@query(rf"""SELECT doc_id, len(l)::BIGINT AS n_links, array_to_string(list_transform(l, lambda x: trim(x)), '; ') AS targets
    FROM (SELECT doc_id, regexp_extract_all({_PAGE}, '\[\[([^\]|]+?)(?:\|[^\]]+)?\]\]', 1) AS l FROM documents)""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    found = _pages(spark, d).select("doc_id", _on_page(lambda c: M.links(c), "array<string>").alias("l"))
    return found.select("doc_id", F.size("l").cast("long").alias("n_links"), F.array_join("l", "; ").alias("targets"))


@query(rf"""WITH p AS (SELECT doc_id, {_PAGE} AS page FROM documents)
    SELECT doc_id, sha256(regexp_replace(regexp_replace(page, '\[\[([^\]|]+)\|[^\]]+\]\]', '[[\1]]', 'g'), '\[\[(?:[^\]|]*/)?([^\]|/]*)\]\]', '[[\1]]', 'g')) AS fixed_sha256,
      len(regexp_extract_all(page, '\[\[[^\]|]+\|[^\]]+\]\]'))::BIGINT AS n_alias,
      len(list_filter(regexp_extract_all(page, '\[\[[^\]|]+\]\]'), lambda x: contains(x, '/')))::BIGINT AS n_path FROM p""")
def page_link_repairs(spark: SparkSession, d: str) -> DataFrame:
    kinds = _pages(spark, d).select(
        "doc_id", _on_page(lambda c: M.fix_links(c), "string").alias("fixed"), _on_page(lambda c: [v["kind"] for v in M.link_violations(c)], "array<string>").alias("k")
    )
    count = lambda kind: F.size(F.filter("k", lambda x: x == kind)).cast("long")
    return kinds.select("doc_id", F.sha2("fixed", 256).alias("fixed_sha256"), count("alias").alias("n_alias"), count("path").alias("n_path"))


@query(rf"""SELECT doc_id, coalesce(source, '') AS status, '' AS dropped, sha256(regexp_replace({_PAGE}, '^---\n[\s\S]*?\n---', '')) AS body_sha256 FROM documents""")
def page_field_edits(spark: SparkSession, d: str) -> DataFrame:
    """A field set and another dropped; the body stays as it is."""
    edited = _pages(spark, d).withColumn("page", M.column(lambda c, s: M.drop_field(M.set_field(c, "status", s), "description"), "string")(F.col("page"), F.col("source")))
    return edited.select(
        "doc_id",
        _on_page(lambda c: M.frontmatter_fields(c).get("status", "none"), "string").alias("status"),
        _on_page(lambda c: M.description_of(c), "string").alias("dropped"),
        F.sha2(_on_page(lambda c: M.split_frontmatter(c)[1], "string"), 256).alias("body_sha256"),
    )


# Line ranges: a line item covers as many lines as its quantity; every second is a parent too.
_START, _END = "l_partkey % 40", "l_partkey % 40 + CAST(l_quantity AS BIGINT)"
_RANGES = f"""c AS (SELECT DISTINCT l_orderkey, l_linenumber AS child, {_START} AS s, {_END} AS e FROM lineitem),
    p AS (SELECT l_orderkey, l_linenumber AS parent, {_START} AS ps, {_END} AS pe FROM lineitem WHERE l_linenumber % 2 = 0)"""
# A child may have several ranges, each of which some range of the parent must hold.
_INSIDE = f"""{_RANGES}, n AS (SELECT l_orderkey, child, count(*) AS n FROM c GROUP BY ALL),
    k AS (SELECT l_orderkey, child, parent, count(DISTINCT (s, e)) AS n FROM c JOIN p USING (l_orderkey) WHERE ps <= s AND e <= pe AND child <> parent GROUP BY ALL),
    i AS (SELECT l_orderkey, child, parent FROM k JOIN n USING (l_orderkey, child, n))"""


def _ranges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_START).alias("start"), F.expr(_END).alias("end"))
    return rows.where("l_linenumber % 2 = 0").withColumnRenamed("l_linenumber", "parent"), rows.withColumnRenamed("l_linenumber", "child")


@query(f"WITH {_INSIDE} SELECT l_orderkey, child, parent FROM i")
def containing_ranges(spark: SparkSession, d: str) -> DataFrame:
    return intervals.containing(*_ranges(spark, d), "l_orderkey")


@query(f"""WITH {_INSIDE}, l AS (SELECT l_orderkey, parent, sum(pe - ps + 1) AS lines FROM p GROUP BY ALL)
    SELECT l_orderkey, child, arg_min(parent, (lines, parent)) AS parent FROM i JOIN l USING (l_orderkey, parent) GROUP BY ALL""")
def smallest_containing_range(spark: SparkSession, d: str) -> DataFrame:
    return intervals.smallest_containing(*_ranges(spark, d), "l_orderkey")


@query(f"""WITH {_RANGES}, x AS (SELECT *, greatest(0, s - pe - 1, ps - e - 1)::BIGINT AS distance FROM c JOIN p USING (l_orderkey)),
    y AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, child ORDER BY distance, parent) AS r FROM x) SELECT l_orderkey, child, parent, distance FROM y WHERE r = 1""")
def nearest_range(spark: SparkSession, d: str) -> DataFrame:
    return intervals.nearest(*_ranges(spark, d), "l_orderkey")


@query("""WITH b AS (SELECT l_orderkey, l_returnflag AS target, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS strength, l_linestatus AS m, l_suppkey AS s FROM lineitem)
    SELECT l_orderkey, target, arg_min(n, (-strength, n)) AS carrier, array_to_string(list_sort(list_distinct(list(m))), ';') AS facts, count(DISTINCT s) AS n_ranges FROM b GROUP BY ALL""")
def consolidated_bundles(spark: SparkSession, d: str) -> DataFrame:
    bundles = load(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_returnflag").alias("target"), F.col("l_linenumber").alias("bundle"), F.col("l_quantity").cast("long").alias("strength"), F.col("l_linenumber").alias("pos"),
        F.array("l_linestatus").alias("facts"), F.array("l_suppkey").alias("ranges"),
    )
    merged = intervals.consolidate(bundles, "l_orderkey", "target")
    return merged.select("l_orderkey", "target", "carrier", F.array_join(F.array_sort("facts"), ";").alias("facts"), F.size("ranges").cast("long").alias("n_ranges"))
