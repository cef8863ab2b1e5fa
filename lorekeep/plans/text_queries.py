"""Queries over texts: tokens, hashes, estimates, windows, lexical retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import context, lexical, maintenance
from lorekeep.plans import indexes
from lorekeep.plans.registry import query, sql_set, sql_tokens
from lorekeep.storage import load

TOK = sql_tokens("text")


@query(f"""SELECT doc_id, len({TOK})::BIGINT AS n_tokens, len({sql_set(TOK)})::BIGINT AS n_distinct FROM documents""")
def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return load(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(
    f"""WITH d AS (SELECT doc_id, {TOK} AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
    e AS (SELECT doc_id, len(t) AS l, unnest(t) AS w FROM d), c AS (SELECT doc_id, l, w, count(*) AS tf FROM e GROUP BY ALL),
    f AS (SELECT w, count(*) AS df FROM c GROUP BY w), q AS (SELECT item_id, unnest({sql_set(TOK)}) AS w FROM benchmark),
    s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score
          FROM q JOIN c USING (w) JOIN f USING (w), n GROUP BY ALL)
    SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
)
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.search_bm25(load(spark, d, "benchmark"), indexes.document_index(spark, d), "item_id", "doc_id", 10)


@query(f"""WITH d AS (SELECT doc_id, {TOK} AS t FROM documents), e AS (SELECT doc_id, unnest(t) AS w FROM d)
    SELECT (SELECT count(*) FROM d) AS n_docs, (SELECT round(avg(len(t)), 6) FROM d) AS avg_length, count(*) AS n_tokens, count(DISTINCT w) AS n_terms FROM e""")
def bm25_index_statistics(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    terms = docs.select(F.explode(T.tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    sizes = lexical.corpus_statistics(docs, "text")
    return terms.agg(sizes.select("n").scalar().alias("n_docs"), F.round(sizes.select("avg_length").scalar(), 6).alias("avg_length"), F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_terms"))


@query(f"""WITH q AS (SELECT item_id, {sql_set(TOK)} AS q FROM benchmark), d AS (SELECT doc_id, {sql_set(TOK)} AS t FROM documents),
    x AS (SELECT item_id, len(q) AS nq, unnest(q) AS w FROM q), y AS (SELECT doc_id, len(t) AS nd, unnest(t) AS w FROM d),
    s AS (SELECT item_id, doc_id, round(count(*) / (any_value(nq) + any_value(nd) - count(*)), 6) AS jaccard FROM x JOIN y USING (w) GROUP BY item_id, doc_id)
    SELECT item_id, doc_id, jaccard, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY jaccard DESC, doc_id) AS rank FROM s) WHERE rank <= 3""")
def max_jaccard_to_documents(spark: SparkSession, d: str) -> DataFrame:
    return lexical.best_jaccard(load(spark, d, "benchmark"), load(spark, d, "documents"), "item_id", "doc_id", limit=3)


FNV = """list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(t) + 1), lambda i: unicode(t[i])::BIGINT)), lambda h, u: (xor(h, u) * 16777619) & 4294967295)"""


@query(f"""SELECT doc_id, 'fnv1a:' || lpad(lower(hex({FNV})), 8, '0') AS content_hash, 'fnv1a:' || lpad(lower(hex({FNV.replace("t)", "b)").replace("t[", "b[")})), 8, '0') AS source_hash
    FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(regexp_replace(coalesce(text, ''), '^---\\n[\\s\\S]*?\\n---\\n?', ''), '\\s+$', '') AS b FROM documents)""")
def doc_fingerprint_fnv(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"), T.source_hash(F.col("text")).alias("source_hash"))


@query("""SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(t) + 1), lambda i: unicode(t[i])::BIGINT)), lambda h, u: (h * 31 + u) & 4294967295) AS hash31,
    sha256(t) AS sha256 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def doc_hashes(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return load(spark, d, "documents").select("doc_id", F.conv(T.annotation_hash(t), 36, 10).cast("long").alias("hash31"), F.sha2(T.text_or_empty(t), 256).alias("sha256"))


@query(r"""WITH k AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(source, '') || chr(10) || coalesce(text, '')), '[\s\p{Z}]+', ' ', 'g')) AS k FROM documents)
    SELECT md5(k) AS key, count(*) AS n, min(doc_id) AS first_doc FROM k GROUP BY md5(k)""")
def exact_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    keyed = load(spark, d, "documents").select("doc_id", F.md5(T.chunk_key(F.col("source"), F.col("text"))).alias("key"))
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query(r"""WITH k AS (SELECT doc_id, source, n_chars, doc_id AS pos, md5(trim(regexp_replace(lower(chr(10) || coalesce(text, '')), '[\s\p{Z}]+', ' ', 'g'))) AS k FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY source, k ORDER BY n_chars % 97 DESC, pos) AS r, min(pos) OVER (PARTITION BY source, k) AS p FROM k)
    SELECT source, doc_id, p AS pos FROM r WHERE r = 1""")
def chunk_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("source", "doc_id", F.col("doc_id").alias("pos"), (F.col("n_chars") % 97).alias("score"), F.lit("").alias("heading"), F.col("text").alias("body"))
    return context.dedupe_chunks(docs, ["source"], "score", "pos").select("source", "doc_id", "pos")


@query("""WITH l AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
    w AS (SELECT doc_id, text, unnest(range(0, (CASE WHEN n <= 1200 THEN 0 ELSE ceil((n - 1200) / 1000) * 1000 END)::BIGINT + 1, 1000)) AS s FROM l)
    SELECT doc_id, s AS start, md5(substr(text, s + 1, 1200)) AS digest, length(substr(text, s + 1, 1200))::BIGINT AS n FROM w""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", F.explode(T.sliding_windows(F.col("text"), 1200, 200)).alias("w"))
    return docs.select("doc_id", F.col("w.start").alias("start"), F.md5("w.text").alias("digest"), F.length("w.text").cast("long").alias("n"))


_OTHER = r"[^\n0-9A-Za-z \t\r\p{L}\p{M}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x{0400}-\x{052F}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]|[\x0B\x0C]"


@query(rf"""WITH c AS (SELECT doc_id, strlen(t) AS bytes, length(t) AS n, length(regexp_replace(t, '[^\x{{0400}}-\x{{052F}}]', '', 'g')) AS cyr,
      length(regexp_replace(t, '[^\x{{3040}}-\x{{30FF}}\x{{4E00}}-\x{{9FFF}}\x{{AC00}}-\x{{D7AF}}]', '', 'g')) AS cjk, length(regexp_replace(t, '[^\n]', '', 'g')) AS nl,
      len(regexp_extract_all(t, '{_OTHER}|[0-9]')) AS sym, len(regexp_extract_all(t, '(?:{_OTHER})+|[0-9]+')) AS runs FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
    r AS (SELECT doc_id, bytes, cyr / 3.5::DOUBLE + cjk + (n - cyr - cjk - nl - sym) / 8.1::DOUBLE + sym / 2.1::DOUBLE + (runs + nl) * 1.1::DOUBLE AS raw FROM c)
    SELECT doc_id, bytes::BIGINT AS bytes, round(raw, 6) AS raw, ceil(round(least(raw, bytes), 9))::BIGINT AS tokens FROM r""")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    m = load(spark, d, "documents").select("doc_id", T.measure_text(F.col("text")).alias("m"))
    return m.select("doc_id", F.col("m.bytes").alias("bytes"), F.round("m.raw", 6).alias("raw"), F.ceil(F.round(T.capped_tokens(F.col("m")), 9)).cast("long").alias("tokens"))


def _lexical_oracle(fields: dict[str, tuple[str, float]], full: str, exact: float, phrase: float, penalty: str, source: str, keys: str, order: str, limit: int) -> str:
    flags = ", ".join(f"{sql_set(sql_tokens(f'({c})'))} AS {n}" for n, (c, _) in fields.items())
    sums = ", ".join(f"sum(list_contains({n}, w)::INT) AS {n}" for n in fields)
    raw = " + ".join(f"{n} / nq * {w}::DOUBLE" for n, (_, w) in fields.items())
    return rf"""WITH p AS ({source}), f AS (SELECT *, {full} AS full_text, ({penalty})::DOUBLE AS pen FROM p),
    t AS (SELECT {keys}, unnest({sql_set(sql_tokens("full_text"))}) AS w, {flags} FROM f),
    q0 AS (SELECT item_id, {sql_tokens("text")} AS l FROM benchmark), q1 AS (SELECT item_id, unnest(l) AS w, unnest(range(len(l))) AS pos FROM q0),
    q AS (SELECT item_id, w, min(pos) AS pos, count(*) OVER (PARTITION BY item_id) AS nq FROM q1 GROUP BY item_id, w),
    h AS (SELECT item_id, {keys}, any_value(nq) AS nq, count(*) AS hits, {sums}, list(w ORDER BY pos) AS m FROM q JOIN t USING (w) GROUP BY item_id, {keys}),
    s AS (SELECT item_id, {keys}, round(({raw} + least(hits, nq) / nq * {exact}::DOUBLE + CASE WHEN len(m) < 2 THEN 0
      WHEN len(list_filter(range(1, len(m)), lambda i: regexp_matches(lower(full_text), m[i] || '[^\p{{L}}\p{{N}}]+' || m[i + 1]))) > 0 THEN 1 ELSE least(0.75, len(m) / nq) END * {phrase}::DOUBLE) * pen, 6) AS score
      FROM h JOIN f USING ({keys}))
    SELECT item_id, {keys}, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, {order}) AS rank FROM s WHERE score > 0) WHERE rank <= {limit}"""


_LEAD = r"substr(regexp_replace(regexp_replace(content, '^\s+', ''), '^#\s+[^\n]*\n?', ''), 1, 500)"
_PAGES = "SELECT doc_id AS id, source || '/' || lang || '_' || doc_id AS path, source AS title, lang || ' ' || source AS description, coalesce(text, '') AS content FROM documents"


@query(
    _lexical_oracle(
        {"f_path": ("path", 2.2), "f_title": ("title", 2.0), "f_description": ("description", 1.0), "f_body": (_LEAD, 0.6)},
        rf"concat_ws(chr(10), path, title, description, {_LEAD})", 0.4, 0.25, "CASE WHEN length(description) <= 1500 THEN 1 ELSE greatest(0.55, 1500 / length(description)) END", _PAGES, "id, path", "id, path", 5,
    )
)
def lexical_page_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.search_pages(load(spark, d, "benchmark"), indexes.page_index(spark, d), "item_id", 5)


_CHUNKS = r"""SELECT article_id, path, ordinal, heading, body FROM (SELECT doc_id AS article_id, source AS path, unnest(range(len(l))) AS ordinal, unnest(l) AS body, lang AS heading
   FROM (SELECT doc_id, source, lang, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)) WHERE length(trim(regexp_replace(body, '\s+', ' ', 'g'))) > 0"""


@query(
    _lexical_oracle(
        {"f_path": ("path", 1.5), "f_heading": ("heading", 2.3), "f_body": ("body", 1.0)},
        "concat_ws(chr(10), path, heading, body)", 0.35, 0.25, "CASE WHEN length(body) <= 1200 THEN 1 ELSE greatest(0.5, 1200 / length(body)) END", _CHUNKS, "article_id, path, ordinal, heading", "article_id, path, ordinal, heading", 5,
    )
)
def lexical_chunk_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.search_chunks(load(spark, d, "benchmark"), indexes.chunk_index(spark, d), "item_id", 5)


@query(r"""SELECT doc_id, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]{3,}')))::BIGINT AS n_query_tokens,
    len(list_distinct(regexp_extract_all(coalesce(text, ''), '\b(?:\d{1,3}\.){3}\d{1,3}\b')))::BIGINT AS n_addresses FROM documents""")
def text_features(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return load(spark, d, "documents").select(
        "doc_id", F.size(T.query_tokens(t)).cast("long").alias("n_query_tokens"), F.size(F.array_distinct(F.regexp_extract_all(T.text_or_empty(t), F.lit(r"\b(?:\d{1,3}\.){3}\d{1,3}\b"), 0))).cast("long").alias("n_addresses")
    )


@query(r"""WITH t AS (SELECT doc_id, replace(lower(trim(lang)), ' ', '-') || '/' || replace(lower(trim(source)), ' ', '-') AS tag FROM documents),
    v AS (SELECT *, string_split(tag, '/')[1] AS category FROM t)
    SELECT category, tag, count(*) AS n, grouping(category, tag)::INT AS level FROM v GROUP BY ROLLUP (category, tag)""")
def tag_rollup(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.tag_rollup(load(spark, d, "documents"), "doc_id", F.concat_ws("/", "lang", "source"))


@query("""SELECT coalesce(source, '-') AS source, coalesce(lang, '-') AS lang, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY ALL""")
def page_histogram(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return docs.groupBy(F.coalesce("source", F.lit("-")).alias("source"), F.coalesce("lang", F.lit("-")).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))
