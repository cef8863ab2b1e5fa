"""Column functions over paths and identifiers of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The root folder of pages and the names of its service files.
ROOT = "!Wiki"
SERVICE_FILES = ["metadata.jsonl", "index.jsonl", "log.jsonl", "_index.md", "_log.md"]


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def page_id(path: Column) -> Column:
    """File name without ``.md``."""
    return F.regexp_replace(basename(path), r"\.md\z", "")


def source_stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?i)\.md\z", "")


def is_article_path(path: Column) -> Column:
    return (path == ROOT) | path.startswith(f"{ROOT}/")


def is_service_path(path: Column) -> Column:
    return path.contains("/_config/") | basename(path).isin(SERVICE_FILES)


def is_page_path(path: Column) -> Column:
    return path.endswith(".md") & ~is_service_path(path)


def is_valid_article(path: Column, folder: Column) -> Column:
    """Exactly ``type/page.md`` below the folder, and no service file."""
    rest = F.substring(path, F.length(folder) + 2, F.length(path))
    return path.startswith(F.concat(folder, F.lit("/"))) & ~is_service_path(path) & ~rest.contains(".config") & (F.size(F.split(rest, "/")) == 2) & path.endswith(".md")


def effective_subfolder(configured: Column, kind: Column) -> Column:
    return F.coalesce(F.nullif(configured, F.lit("")), basename(kind))


def sanitised_folder(raw: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(raw, r"\Avaults/[^/]+/", ""), r"\A!Wiki/", "")
    return basename(bare)


def is_stem(stem: Column, domain: str | None = None) -> Column:
    middle = r"[a-z0-9_\-]+" if domain is None else domain.replace("-", r"\-")
    return stem.rlike(rf"\Awiki_{middle}_[a-z0-9_]+\z")


def slug(name: Column) -> Column:
    """Camel case split, other characters to underscores, lower case. Accents go
    first by ``fold_accents``, which a native expression cannot do in general."""
    t = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(F.regexp_replace(t, "[^A-Za-z0-9]+", "_"), r"\A_+|_+\z", ""))


@F.pandas_udf(StringType())
def fold_accents(names):
    """Canonical decomposition without its marks."""
    import unicodedata

    return names.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.category(c).startswith("M")))


def stem(domain: Column, name: Column) -> Column:
    return F.concat(F.lit("wiki_"), domain, F.lit("_"), slug(fold_accents(name)))


def entity_type(folder: Column, path: Column) -> Column:
    """First folder below the domain's, or ``concept``."""
    rest = F.substring(path, F.length(folder) + 2, F.length(path))
    return F.when(path.startswith(F.concat(folder, F.lit("/"))) & rest.contains("/"), F.split(rest, "/")[0]).otherwise(F.lit("concept"))


def id_parts(stem_: Column) -> Column:
    """struct<prefix, digits> of the first id-like token; null without one."""
    pattern = r"(?i)([a-z]{1,8})?[-_ ]?([0-9]{2,})"
    return F.when(
        stem_.rlike(pattern),
        F.struct(F.lower(F.regexp_extract(stem_, pattern, 1)).alias("prefix"), F.regexp_extract(stem_, pattern, 2).alias("digits")),
    )


def page_record_id(article: Column) -> Column:
    return F.concat(F.lit("page:"), article)


def chunk_record_id(article: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("chunk:"), article, F.lit(":"), ordinal.cast("string"))


def reranker_id(article: Column, ordinal: Column) -> Column:
    return F.concat(article, F.lit("::"), ordinal.cast("string"))
