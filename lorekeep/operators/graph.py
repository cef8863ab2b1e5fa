"""Link graphs as tables: ``nodes(id)`` of known pages and ``edges(src, dst)``,
whose targets may be unknown (phantoms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.storage import dealt, materialise

WIKI_LINK = r"\[\[([^\]|#]+)"
HREF = r'href="([^"]*)"'
#: Links of a node in one part; the share of open nodes from which a frontier is large.
HUB, LARGE = 10_000, 0.2


def link_edges(pages: DataFrame, id_: str, content: str, pattern: str = WIKI_LINK, target=lambda t: F.trim(t)) -> DataFrame:
    """Distinct (src, dst) links of each page; blank targets are no links."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(content), F.lit("")), F.lit(pattern), 1), target))
    return pages.select(F.col(id_).alias("src"), F.explode(found).alias("dst")).where("dst <> ''").distinct()


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree): links to every node, unknown targets included."""
    counted = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return nodes.select("id").distinct().join(counted, "id", "full").select("id", F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Known nodes without any link in or out."""
    return nodes.select("id").distinct().join(edges.select(F.col("src").alias("id")), "id", "left_anti").join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def unreciprocated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Links between known nodes without one back."""
    known = edges.join(nodes.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    return known.join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti").select("src", "dst")


def structure_issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, issue) of isolated nodes and of links that are not returned."""
    alone = isolated(nodes, edges).select("id", F.lit("isolated node (no links in or out)").alias("issue"))
    one_way = unreciprocated(nodes, edges).select(F.col("src").alias("id"), F.concat(F.lit("→ [["), F.col("dst").cast("string"), F.lit("]] not reciprocated")).alias("issue"))
    return alone.unionByName(one_way)


def broken_links(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct targets that are no known id."""
    return edges.select(F.col("dst").alias("id")).distinct().join(known.select("id"), "id", "left_anti")


def dead_links_by_suffix(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Links for which no path ends with ``target.md``. A path that ends so ends, from
    some character on, with the target, so all suffixes that start a
    path's file name or a folder above, and those inside the name, are joined by equality."""
    stems = paths.select(F.regexp_replace("path", r"\.md\z", "").alias("p")).where(F.col("p") != "")
    suffixes = stems.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("p")), lambda i: F.substring("p", i, F.length("p")))).alias("dst")).distinct()
    return edges.select("src", "dst").join(suffixes, "dst", "left_anti")


def salted(steps: DataFrame, hub: int) -> tuple[DataFrame, DataFrame]:
    """(steps (a, b) with a ``part``, hubs (a, parts)): the steps from a node of more than ``hub``
    are dealt into as many parts as they fill, so that no key holds many more than ``hub`` rows."""
    hubs = steps.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / hub).cast("long").alias("parts")).where("parts > 1")
    # One hub in ``hub`` rows at most, so they go to every task.
    parted = steps.join(F.broadcast(hubs), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1).cast("long"))).alias("part"))
    return parted, hubs


def bfs(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int, group: list[str] = (), hub: int = HUB) -> DataFrame:
    """(*group, id, hop): nodes within ``depth`` hops of the seeds, links taken
    both ways, with the hop of first discovery. Links lead forward only to known
    nodes; a seed stays even if unknown, and still expands backwards.

    Each hop is an equi-join on (node, part), less what is visited: a hub's links lie in parts
    of bounded size, and a frontier row of a hub goes to each. Without a group, a frontier of more than a
    ``LARGE`` share of the open nodes is met from their side: an open node is reached if one
    of its links leads to the frontier, whichever. Every hop is written."""
    group = list(group)
    edges = materialise(edges.select("src", "dst"), "bfs-edges")
    rows = 2 * edges.count()
    forward = edges.join(nodes.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = forward.unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).where("a is not null and b is not null")
    steps = materialise(dealt(both, rows, "a", "b").distinct(), "bfs-steps")
    parted, hubs = salted(steps, hub)
    hubs = materialise(hubs, "bfs-hubs")
    parted = materialise(parted, "bfs-parts")
    visited = frontier = materialise(seeds.select(*group, "id").distinct().withColumn("hop", F.lit(0)), "bfs-hop")
    for hop in range(1, depth + 1):
        far = None
        if not group and hop > 1:
            far = steps.select(F.col("b").alias("id")).distinct().join(visited.select("id"), "id", "left_anti")
            far = far if frontier.count() > far.count() * LARGE else None
        if far is not None:
            met = dealt(parted, rows, "b").join(far, F.col("b") == F.col("id"), "left_semi")
            reached = met.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        else:
            parts = frontier.join(hubs, F.col("id") == F.col("a"), "left").select(*group, "id", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1)).alias("part"))
            reached = parts.join(dealt(parted, rows, "a", "part").withColumnRenamed("part", "own"), (F.col("id") == F.col("a")) & (F.col("part") == F.col("own"))).select(*group, F.col("b").alias("id")).distinct()
        frontier = materialise(reached.join(visited.select(*group, "id"), [*group, "id"], "left_anti").withColumn("hop", F.lit(hop)), "bfs-hop")
        visited = visited.unionByName(frontier)
        if frontier.isEmpty():
            break
    return visited


def bfs_ranked(expanded: DataFrame, scores: DataFrame, group: list[str], top_k: int) -> DataFrame:
    """Seeds (hop 0) and the ``top_k`` best scored others; all of them if top_k <= 0."""
    if top_k <= 0:
        return expanded.select(*group, "id", "hop")
    scored = expanded.where("hop > 0").join(scores.select(*group, "id", "score"), [*group, "id"])
    order = [F.col("score").desc(), F.col("id")]
    if group:
        scored = scored.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__r") <= top_k)
    best = (scored if group else scored.orderBy(*order).limit(top_k)).select(*group, "id", "hop")
    return expanded.where("hop = 0").select(*group, "id", "hop").unionByName(best)


def unique_owners(identities: DataFrame, identity: Column, path: Column) -> DataFrame:
    """(identity, path) of identities that exactly one path owns."""
    return identities.select(identity.alias("identity"), path.alias("path")).groupBy("identity").agg(F.count_distinct("path").alias("n"), F.min("path").alias("path")).where("n = 1").select("identity", "path")


def alias_conflicts(identities: DataFrame) -> DataFrame:
    """Identities of ``identities(identity, path)`` that several paths own."""
    return identities.groupBy("identity").agg(F.array_sort(F.collect_set("path")).alias("paths")).where(F.size("paths") > 1)


def resolve_ids(broken: DataFrame, candidates: DataFrame) -> DataFrame:
    """Resolves broken stems by their id-like token: (broken, kind, stem).

    A candidate fits if its digits contain the broken digits and the prefix
    agrees where there is one. All substrings of candidates' digits (id tokens
    are short) make it an equi-join. Several entities are ambiguous; of one
    entity's stems a ``wiki_`` one is preferred, then the first by ``pos``."""
    from lorekeep.functions.paths import id_parts

    b = broken.select(F.col("stem").alias("broken"), id_parts(F.col("stem")).alias("i")).select("broken", F.col("i.prefix").alias("prefix"), F.col("i.digits").alias("digits"))
    c = candidates.select("stem", "pos", id_parts(F.col("stem")).alias("i")).where("i is not null").select("stem", "pos", F.col("i.prefix").alias("p"), F.col("i.digits").alias("d"))
    n = F.length("d")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring("d", i, k))))
    parts = F.array_distinct(parts)
    fits = b.where("digits is not null").join(c.select("stem", "pos", "p", F.concat("p", "d").alias("entity"), F.explode(parts).alias("digits")), "digits").where("prefix = '' or prefix = p")
    found = fits.groupBy("broken").agg(F.count_distinct("entity").alias("n"), F.min_by("stem", F.struct(~F.col("stem").startswith("wiki_"), "pos")).alias("stem"))
    return b.select("broken").join(found, "broken", "left").select(
        "broken",
        F.when(F.col("n").isNull(), "unresolved").when(F.col("n") > 1, "ambiguous").otherwise("resolved").alias("kind"),
        F.when(F.col("n") == 1, F.col("stem")).alias("stem"),
    )
