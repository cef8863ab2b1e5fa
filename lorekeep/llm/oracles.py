"""DuckDB SQL for the queries that SQL can express."""

OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
       list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
       list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(t, '\p{Lu}+', 'A', 'g'),
         '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}\p{M}]+', 'a', 'g'), '\p{N}+', '9', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ss FROM d),
tri AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY r),
gram AS (SELECT r, doc_id, g FROM (SELECT r, doc_id, unnest(list_transform(range(1, len(ss) + 1), lambda i: ss[i] || ' ' || coalesce(ss[i + 1], ''))) AS g FROM w)),
tbl AS (SELECT list(list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) q(i)),
hexed AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM gram)),
hashed AS (SELECT g, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::UBIGINT)),
   lambda c, b: xor(c >> 8, tbl.t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 4096 AS b FROM hexed, tbl),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
cnt AS (SELECT b, count(*) AS c, count(good.doc_id) AS m FROM gram JOIN hashed USING (g) LEFT JOIN good USING (doc_id) GROUP BY b),
tot AS (SELECT sum(c) AS n, sum(m) AS m FROM cnt),
wt AS (SELECT b, CASE WHEN tot.m = 0 THEN 0 ELSE ln((cnt.m + 1) / (tot.m + 4096)) - ln((c + 1) / (tot.n + 4096)) END AS x FROM cnt, tot),
sc AS (SELECT r, round(sum(x) / count(*), 6) AS llr FROM gram JOIN hashed USING (g) JOIN wt USING (b) GROUP BY r),
base AS (SELECT w.r, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
   (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
   coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(sc.llr, 0.0) AS llr FROM w LEFT JOIN cov USING (r) LEFT JOIN sc USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND llr >= -0.5 AS kept, llr FROM base
"""

OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
  row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS LAST, r) = 1 AS kept, s AS text_sha256 FROM d
"""

OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT r, CASE WHEN i > 1 THEN ws[i - 1] ELSE '' END AS v, ws[i] AS w FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
u AS (SELECT w, count(*) AS c FROM g GROUP BY w UNION ALL SELECT '', count(*) FROM d WHERE len(ws) > 0),
p AS (SELECT v, w, count(*) AS c FROM g GROUP BY v, w),
n AS (SELECT count(*) AS n FROM g),
s AS (SELECT g.r, count(*) AS n, sum(CASE WHEN p.c < 2 THEN 1 ELSE 0 END) AS b,
        sum(CASE WHEN p.c >= 2 THEN ln(p.c) - ln(x.c) ELSE ln(0.4) + ln(y.c) - ln(n.n) END) AS s
      FROM g JOIN p USING (v, w) JOIN u x ON x.w = g.v JOIN u y ON y.w = g.w, n GROUP BY g.r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(s.b, 0)::BIGINT AS n_backoff, round(s.s / s.n, 6) AS score FROM d LEFT JOIN s USING (r)
"""

OP11 = """
WITH v AS (SELECT row_number() OVER () AS u, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.u AS au, a.vec_id AS anchor_id, b.u AS bu, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.u <> b.u WHERE a.vec_id % 100 = 0),
p AS (SELECT au, bu AS pu, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY au ORDER BY score DESC, vec_id NULLS LAST) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY au, pu ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
      FROM p JOIN s USING (au) WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
c AS (SELECT r, doc_id, n, w, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS w FROM d) GROUP BY ALL),
q AS (SELECT i, item_id, w, count(*) AS k FROM (SELECT i, item_id, unnest(t) AS w FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS t FROM benchmark)) GROUP BY ALL),
x AS (SELECT w, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS x FROM (SELECT w, count(*) AS df FROM c GROUP BY w), s),
p AS (SELECT i, item_id, r, doc_id, sum(k * x * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // l))))::BIGINT AS score
      FROM q JOIN c USING (w) JOIN x USING (w), s GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM p WHERE score > 0) WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op1_quality_rules": OP1, "op2_exact_dedup": OP2, "op5_backoff_scores": OP5, "op11_hard_negatives": OP11, "op13_ranked_search": OP13}
