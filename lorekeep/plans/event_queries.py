"""Queries over event logs: session reports, orderings, percentiles, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import ranking
from lorekeep.plans.registry import query
from lorekeep.storage import load
from lorekeep.streaming import lifecycle


@query("""SELECT user_id, count(*) AS n, count_if(event_type = 'error') AS errors, count_if(event_type = 'click') AS clicks, arg_min(event_type, event_id) AS first_type,
    epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS most FROM events GROUP BY user_id""")
def session_report(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    return load(spark, d, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(e == "error").alias("errors"), F.count_if(e == "click").alias("clicks"), F.min_by("event_type", "event_id").alias("first_type"),
        (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("span_us"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.max("value").alias("most"),
    )


@query("""SELECT user_id, round(quantile_cont(value, 0.95), 6) AS linear, list_sort(list(value))[least(floor(count(*) * 0.95)::BIGINT, count(*) - 1) + 1] AS floored,
    list_sort(list(value))[greatest(ceil(count(*) * 0.95)::BIGINT, 1)] AS nearest FROM events GROUP BY user_id""")
def percentile_three_ways(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy("user_id").agg(F.round(ranking.percentile_linear("value", 0.95), 6).alias("linear"), ranking.percentile_floor("value", 0.95).alias("floored"), ranking.percentile_nearest("value", 0.95).alias("nearest"))


_RANK = "CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END"


@query(f"""WITH o AS (SELECT *, {_RANK} AS r FROM events), w AS (SELECT *, lag(r) OVER s AS pr, lag(ts) OVER s AS pt, max((r >= 3)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done
      FROM o WINDOW s AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, event_id, CASE WHEN done = 1 THEN 'after terminal' WHEN r < pr THEN 'out of order' ELSE 'time decreases' END AS problem FROM w WHERE done = 1 OR r < pr OR ts < pt""")
def lifecycle_violations(spark: SparkSession, d: str) -> DataFrame:
    """Users as calls: phases must not go back, nor follow a terminal one, nor time decrease."""
    return lifecycle.violations(load(spark, d, "events"), "user_id", "event_id", "ts", "event_type", lifecycle.EVENT_PHASES)


@query("""WITH e AS (SELECT user_id, event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events WHERE event_type IN ('error', 'click', 'purchase'))
    SELECT event_id, CASE WHEN next IS NULL THEN 'open' WHEN next = 'error' THEN 'exhausted' ELSE 'recovered' END AS outcome FROM e WHERE event_type = 'error'""")
def retry_pairing(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.retry_outcomes(load(spark, d, "events"), "user_id", "event_id", "event_type", "error", ["click", "purchase"]).select("event_id", "outcome")


@query("""SELECT user_id, CASE WHEN max((event_type = 'error')::INT) = 1 THEN 'error' WHEN max((event_type = 'purchase')::INT) = 1 THEN 'done' ELSE 'running' END AS status FROM events GROUP BY user_id""")
def run_status(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.run_status(load(spark, d, "events"), "user_id", F.col("event_type") == "error", F.col("event_type") == "purchase")


@query("""SELECT user_id, sum((props->>'k')::BIGINT) AS tokens, round(1000 * sum((props->>'k')::BIGINT) / sum(value), 6) AS per_second, list_sort(list(value))[floor(count(*) / 2)::BIGINT + 1] AS upper_median FROM events GROUP BY user_id""")
def speed_report(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    upper = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value DESC)").alias("upper_median")
    return load(spark, d, "events").groupBy("user_id").agg(F.sum(k).alias("tokens"), F.round(1000 * F.sum(k) / F.sum("value"), 6).alias("per_second"), upper)


@query("""SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    hour = F.date_trunc("hour", "ts").alias("hour")
    return load(spark, d, "events").groupBy("event_type", hour).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT event_type, count(*) AS n, count_if(value > 10) AS high, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY event_type""")
def running_counters(spark: SparkSession, d: str) -> DataFrame:
    """The counters that the streaming query keeps, over the whole log."""
    return lifecycle.counters(load(spark, d, "events"))
