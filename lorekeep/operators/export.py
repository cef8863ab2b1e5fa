"""Export of pages, domain events, errors and proofs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lorekeep.functions import markdown as M
from lorekeep.functions import paths as P
from lorekeep.storage import ship


def stem_paths(pages: DataFrame, position: str = "path") -> DataFrame:
    """(stem, path): of paths with one stem the last."""
    return pages.select(P.page_id(F.col("path")).alias("stem"), "path", F.col(position).alias("__p")).groupBy("stem").agg(F.max_by("path", "__p").alias("path"))


def export_pages(pages: DataFrame, descriptions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(exported(path, content), index(path, title, description), dead(path, target)).

    Link targets are looked up by a join on the links of each page, so a page
    is rewritten with just the paths that it needs."""
    ship(pages.sparkSession)
    found = M.column(lambda content: [t.split("#")[0].strip() for t in M.links(content)], ArrayType(StringType()))
    linked = pages.select("path", F.explode(F.array_distinct(found(F.col("content")))).alias("stem")).join(stem_paths(pages).withColumnRenamed("path", "target"), "stem")
    needed = linked.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("stem", "target"))).alias("targets"))
    kind = StructType([StructField("body", StringType()), StructField("dead", ArrayType(StringType()))])

    def rewrite(content, targets):
        head, body = M.split_frontmatter(content)
        fresh, dead = M.to_markdown_links(body, dict(targets or {}))
        return {"body": head + fresh, "dead": dead}

    def batch(contents: pd.Series, targets: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rewrite(c or "", t if isinstance(t, dict) else {}) for c, t in zip(contents, targets)])

    done = pages.join(needed, "path", "left").withColumn("r", F.pandas_udf(batch, kind)("content", "targets"))
    titled = M.column(M.title_of, StringType())
    index = pages.select("path", titled(F.col("content"), P.page_id(F.col("path"))).alias("title")).join(descriptions, "path", "left")
    return done.select("path", F.col("r.body").alias("content")), index, done.select("path", F.explode("r.dead").alias("target"))


def write_pages(exported: DataFrame, folder: str) -> None:
    """One text file a page under Spark's writer, so any shared store will do."""
    exported.select(F.regexp_replace("path", "[^A-Za-z0-9_./-]", "_").alias("page"), F.col("content").alias("value")).write.mode("overwrite").partitionBy("page").text(folder)


def apply_domain_events(domains: DataFrame, events: DataFrame) -> DataFrame:
    """(id, name, source_paths) after ``events(seq, op, id, name, path)`` with
    ``create``, ``update``, ``add_path``, ``remove_path`` and ``delete``: the last
    event of each domain and path decides, so no state is folded."""
    created = events.where("op in ('create', 'update') and name is not null").groupBy("id").agg(F.max_by("name", "seq").alias("new_name"), F.min("seq").alias("first"))
    life = events.where("op in ('create', 'delete')").groupBy("id").agg(F.max_by("op", "seq").alias("life"), F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("gone"))
    old = domains.select("id", F.explode("source_paths").alias("path")).withColumns({"op": F.lit("add_path"), "seq": F.lit(-1).cast("long")})
    moves = old.unionByName(events.where("op in ('add_path', 'remove_path')").select("id", "path", "op", F.col("seq").cast("long").alias("seq")))
    moves = moves.join(life, "id", "left").where("gone is null or seq > gone")
    paths = moves.groupBy("id", "path").agg(F.max_by("op", "seq").alias("op")).where("op = 'add_path'").groupBy("id").agg(F.sort_array(F.collect_list("path")).alias("source_paths"))
    everyone = domains.select("id", "name").join(created, "id", "full").join(life, "id", "left").where("life is null or life <> 'delete'")
    return everyone.join(paths, "id", "left").select("id", F.coalesce("new_name", "name").alias("name"), F.coalesce("source_paths", F.array().cast("array<string>")).alias("source_paths"))


def context_error(message: Column) -> Column:
    """struct<overflow boolean, prompt long, most long> of an error text: whether
    it says that a prompt exceeds a context, with the counts where it names them."""
    low = F.lower(F.coalesce(message, F.lit("")))
    number = lambda pattern, i: F.regexp_replace(F.nullif(F.regexp_extract(low, pattern, i), F.lit("")), "[,_ ]", "").try_cast("long")
    asked = r"(?:prompt|messages?|input|requested)[^0-9]{0,50}([0-9][0-9,_]*)"
    limit = r"(?:maximum|max|context)[a-z ]{0,40}[^0-9]{0,30}([0-9][0-9,_]*)"
    prompt, most = number(asked, 1), number(limit, 1)
    about = low.rlike(r"\b(?:input|prompt|messages?|context)\b")
    other = low.rlike(r"\b(?:billing|credits?|quota|rate\s+limit|timeout|timed?\s*out|deadline)\b")
    said = low.rlike(r"exceed|overflow|too\s+(?:long|large|many)|over\s+(?:the\s+)?(?:limit|maximum)|(?:greater|more)\s+than|beyond")
    return F.struct((about & ~other & (said | F.coalesce(prompt > most, F.lit(False)))).alias("overflow"), prompt.alias("prompt"), most.alias("most"))


def retry_delay(attempt: Column, header_ms: Column, jitter: Column, base: int = 500, most: int = 8000) -> Column:
    """Milliseconds before a retry, ``most`` at most: the server's wish if it is a time
    from now on, else doubling from ``base``, of which a share of up to a quarter goes by ``jitter`` (0 to 1)."""
    wish = header_ms.cast("double")
    doubled = F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), F.greatest(F.lit(1), F.floor(attempt)) - 1))
    random = F.least(F.lit(1.0), F.greatest(F.lit(0.0), jitter.cast("double")))
    return F.when(wish >= 0, F.least(F.round(wish), F.lit(float(most)))).otherwise(F.round(doubled * (0.75 + 0.25 * random)))


def entries_hash(entries: Column) -> Column:
    """SHA-256 over sorted, length-prefixed entries."""
    return F.sha2(F.array_join(F.transform(F.sort_array(entries), lambda e: F.concat(F.octet_length(e).cast("string"), F.lit(":"), e)), ""), 256)


def chain_roots(chunks: DataFrame, key: str, order: str, digest: str) -> DataFrame:
    """(key, root): a hash chain over a key's chunk digests in order."""
    rows = chunks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, F.col(digest).alias("d")))).alias("c"))
    return rows.select(key, F.aggregate("c", F.lit(""), lambda acc, x: F.sha2(F.concat(acc, F.lit("|"), x["d"]), 256)).alias("root"))


def reassemble(segments: DataFrame, expected: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(texts(key, text) in order of ``ordinal``, problems(key, ordinal, problem))."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "")
    counted = segments.groupBy(key, "ordinal").agg(F.count(F.lit(1)).alias("n"))
    both = expected.select(key, "ordinal", F.lit(True).alias("e")).join(counted, [key, "ordinal"], "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    return segments.groupBy(key).agg(text.alias("text")), both.select(key, "ordinal", problem.alias("problem")).where("problem is not null")


def merge_pools(pools: DataFrame, group: list[str], order: str, limit: int) -> DataFrame:
    """One pool of candidates from several domains: of an id that several have the
    last by ``order`` counts; the ``limit`` (1 to 100) best by score stay."""
    w = Window.partitionBy(*group, "id").orderBy(F.col(order).desc())
    one = pools.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("score").desc(), "id")))
    return ranked.where(F.col("rank") <= max(1, min(100, limit)))
