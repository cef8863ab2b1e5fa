"""Queries whose operators ask an evaluator."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import evaluated
from lorekeep.plans.registry import query
from lorekeep.storage import load, ship


@query("""WITH d AS (SELECT source, n_chars FROM documents), s AS (SELECT source, count(*) AS n, max(n_chars) AS most FROM d GROUP BY source),
    b AS (SELECT source, n, most, unnest(range(1, 401)) AS budget FROM s),
    c AS (SELECT b.source, b.budget, any_value(n) AS n, any_value(most) AS most, sum(ceil(n_chars / (b.budget * 64))) AS chunks FROM b JOIN d ON b.source IS NOT DISTINCT FROM d.source GROUP BY b.source, b.budget)
    SELECT s.source, max(c.budget) FILTER (WHERE chunks <= 6 * c.n AND c.budget * 64 <= c.most / 2) AS budget, true AS few FROM s LEFT JOIN c ON s.source IS NOT DISTINCT FROM c.source GROUP BY s.source""")
def feasible_budget_search(spark: SparkSession, d: str) -> DataFrame:
    """The largest chunk size of each source, in units of 64 characters, that gives at most six
    chunks a document on average and does not exceed half of the longest document."""
    docs = load(spark, d, "documents").select("source", "n_chars")

    def evaluate(asked: DataFrame) -> DataFrame:
        met = asked.alias("a").join(docs.alias("d"), F.col("a.source").eqNullSafe(F.col("d.source")))
        size = F.col("budget") * 64
        judged = met.groupBy("a.source", "budget").agg(F.sum(F.ceil(F.col("n_chars") / size)).alias("chunks"), F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("most"))
        verdict = F.when(F.col("chunks") > 6 * F.col("n"), "too small").when(size > F.col("most") / 2, "too large").otherwise("feasible")
        return judged.select("source", "budget", verdict.alias("verdict"))

    groups = docs.select("source").distinct().select("source", F.lit(1).alias("low"), F.lit(400).alias("high"))
    return evaluated.search_budgets(groups, ["source"], evaluate).select("source", "budget", (F.col("evaluations") <= 9).alias("few"))


@query("""WITH RECURSIVE t AS (SELECT doc_id, 0 AS attempt, n_chars AS budget, 200 + doc_id % 3000 AS most FROM documents
      UNION ALL SELECT doc_id, attempt + 1, greatest(1, least(budget - 1, CASE WHEN doc_id % 2 = 0 THEN floor(budget * most / budget * 0.9::DOUBLE) ELSE floor(budget * 0.75::DOUBLE) END))::BIGINT, most
      FROM t WHERE attempt < 2 AND budget > 1 AND budget > most AND doc_id % 11 <> 0)
    SELECT doc_id, attempt, budget, CASE WHEN doc_id % 11 = 0 THEN 'refused' WHEN budget <= most THEN 'ok' ELSE 'overflow' END AS outcome FROM t""")
def repacked_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests of the documents' sizes against limits that a service tells of every other one."""
    docs = load(spark, d, "documents").select("doc_id", F.col("n_chars").alias("budget"))

    def execute(asked: DataFrame) -> DataFrame:
        most, told = 200 + F.col("doc_id") % 3000, F.col("doc_id") % 2 == 0
        outcome = F.when(F.col("doc_id") % 11 == 0, "refused").when(F.col("budget") <= most, "ok").otherwise("overflow")
        return asked.select("doc_id", "budget", outcome.alias("outcome"), F.when(told, F.col("budget")).alias("prompt"), F.when(told, most).alias("most"))

    return evaluated.repacked(docs, ["doc_id"], execute).select("doc_id", "attempt", "budget", "outcome")


def _score(part: pd.DataFrame) -> pd.DataFrame:
    """A scorer that takes at most 60,000 characters at once."""
    if part["n_chars"].sum() > 60_000:
        raise evaluated.TooLarge("too many characters")
    return pd.DataFrame({"score": part["n_chars"] % 97})


@query("""WITH RECURSIVE b AS (SELECT doc_id // 64 AS batch, list({'k': doc_id, 'n': n_chars} ORDER BY doc_id) AS l FROM documents GROUP BY doc_id // 64),
    p AS (SELECT batch, l, 0::BIGINT AS low, len(l)::BIGINT AS high FROM b UNION ALL
      SELECT batch, l, CASE WHEN h = 0 THEN low ELSE (low + high + 1) // 2 END, CASE WHEN h = 0 THEN (low + high + 1) // 2 ELSE high END
      FROM p, (VALUES (0), (1)) t(h) WHERE high - low > 1 AND list_sum(list_transform(l[low + 1 : high], lambda x: x.n)) > 60000),
    c AS (SELECT batch, count(*) AS calls FROM p GROUP BY batch),
    e AS (SELECT *, list_sum(list_transform(l[low + 1 : high], lambda x: x.n)) > 60000 AS large FROM p), f AS (SELECT * FROM e WHERE NOT (large AND high - low > 1)),
    u AS (SELECT batch, large, high - low AS part, unnest(l[low + 1 : high]) AS x FROM f)
    SELECT x.k AS doc_id, CASE WHEN large THEN NULL ELSE x.n % 97 END AS score, part::INT AS part, calls::INT AS calls, CASE WHEN large THEN 'too many characters' END AS error FROM u JOIN c USING (batch)""")
def split_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of documents in batches of 64 ids, halved where the scorer takes no more."""
    ship(spark)
    docs = load(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 64).alias("batch"), "n_chars")
    return evaluated.split_on_failure(docs, ["batch"], ["doc_id"], _score, "score long").select("doc_id", "score", "part", "calls", "error")


@query("""WITH f AS (SELECT source, unnest(['a' || doc_id % 5, 'b' || n_chars % 4]) AS fact, unnest([2 * doc_id, 2 * doc_id + 1]) AS p FROM documents WHERE source IS NOT NULL),
    g AS (SELECT source, fact, min(p) AS p FROM f GROUP BY source, fact)
    SELECT source, string_agg(fact, ',' ORDER BY p) AS facts, 'reduced' AS status, true AS bounded FROM g GROUP BY source""")
def reduced_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Facts of each source's documents, reduced in batches that cost 200 at most."""
    facts = F.array(F.concat(F.lit("a"), (F.col("doc_id") % 5).cast("string")), F.concat(F.lit("b"), (F.col("n_chars") % 4).cast("string")))
    packets = load(spark, d, "documents").where("source is not null").select("source", "doc_id", facts.alias("facts"))
    cost = lambda c: F.lit(10) + F.aggregate(c, F.lit(0), lambda s, x: s + F.length(x))
    out, batches = evaluated.reduce_tree(packets, "source", "doc_id", "facts", cost, 200)
    paid = batches.groupBy("source").agg(F.max("cost").alias("cost"))
    return out.join(paid, "source").select("source", F.array_join("facts", ",").alias("facts"), "status", ((F.col("depth") <= 8) & (F.col("cost") <= 200)).alias("bounded"))
