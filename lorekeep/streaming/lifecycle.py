"""Event logs as streams: lifecycles, counters, idempotent ingestion.

The batch forms audit a whole log with windows; the streaming forms keep the
same state by key. A late or impossible event becomes a violation row, and the stream goes on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of the phases; the terminal ones are from ``TERMINAL`` on.
EVENT_PHASES = {"signup": 0, "view": 1, "click": 2, "purchase": 3, "error": 4}
TERMINAL = 3
#: State of a key whose last event had no phase, or no time: below every other.
NO_PHASE, NO_TIME = -(1 << 31), -(1 << 63)


def phase_rank(kind: Column, phases: dict[str, int]) -> Column:
    ranks = F.lit(None).cast("int")
    for name, r in phases.items():
        ranks = F.when(kind == name, r).otherwise(ranks)
    return ranks


def violations(events: DataFrame, key: str, seq: str, ts: str, kind: str, phases: dict[str, int], terminal: int = TERMINAL) -> DataFrame:
    """(key, seq, problem) of events after a terminal one, of a lower phase than
    the one before, or earlier in time, in that order of precedence."""
    w = Window.partitionBy(key).orderBy(seq)
    r = phase_rank(F.col(kind), phases)
    ranked = events.select(key, seq, F.col(ts).alias("__t"), r.alias("__r"))
    seen = ranked.withColumns(
        {"__pr": F.lag("__r").over(w), "__pt": F.lag("__t").over(w), "__done": F.max((F.col("__r") >= terminal).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))}
    )
    problem = F.when(F.col("__done") == 1, "after terminal").when(F.col("__r") < F.col("__pr"), "out of order").when(F.col("__t") < F.col("__pt"), "time decreases")
    return seen.select(key, seq, problem.alias("problem")).where("problem is not null")


def retry_outcomes(events: DataFrame, key: str, seq: str, kind: str, failed: str, recovered: list[str]) -> DataFrame:
    """Each failure's outcome by the next failure or success of its key."""
    w = Window.partitionBy(key).orderBy(seq)
    kept = events.where(F.col(kind).isin(failed, *recovered)).select(key, seq, kind).withColumn("__next", F.lead(kind).over(w))
    outcome = F.when(F.col("__next").isNull(), "open").when(F.col("__next") == failed, "exhausted").otherwise("recovered")
    return kept.where(F.col(kind) == failed).select(key, seq, outcome.alias("outcome"))


def run_status(events: DataFrame, key: str, failed: Column, done: Column) -> DataFrame:
    """Terminal status of each run: an error absorbs all else."""
    state = F.max(F.when(failed, 2).when(done, 1).otherwise(0))
    return events.groupBy(key).agg(F.when(state == 2, "error").when(state == 1, "done").otherwise("running").alias("status"))


def finalised_status(status: Column, aborted: Column, timed_out: Column) -> Column:
    return F.when(status == "error", "error").when(aborted, "aborted").when(timed_out, "timed out").otherwise(status)


def counters(events: DataFrame) -> DataFrame:
    """Running counters by type; the same aggregate in batch and in a stream."""
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 10).alias("high"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


def windowed_counts(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts in tumbling windows of a stream; later than ``delay`` is dropped by the watermark."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def _judged(state: tuple[int, int, bool], kind: str | None, time: int | None, phases: dict[str, int], terminal: int) -> tuple[tuple[int, int, bool], str | None]:
    """(state after an event, its problem), by the rules of ``violations``."""
    rank, last, done = state
    r = phases.get(kind)
    problem = "after terminal" if done else "out of order" if r is not None and r < rank else "time decreases" if time is not None and time < last else None
    return (NO_PHASE if r is None else r, NO_TIME if time is None else time, done or (r is not None and r >= terminal)), problem


def _violation_rows(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["user_id", "event_id", "problem"]).astype({"user_id": "int64", "event_id": "int64"})


def _micros(ts) -> int | None:
    return None if pd.isna(ts) else pd.Timestamp(ts).value // 1000


def lifecycle_stream(events: DataFrame, phases: dict[str, int] = EVENT_PHASES, terminal: int = TERMINAL, forget_ms: int | None = None) -> DataFrame:
    """Violations of a stream of (user_id, event_id, ts, event_type), with each
    key's phase, time and whether it has ended as state. Events of one micro-batch
    are taken in order of ``event_id``. Results are those of ``violations``: an event of
    another kind has no phase, one without a time is not compared. With ``forget_ms``
    the state of a key is dropped once it has had no event for that long."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = tuple(state.get) if state.exists else (NO_PHASE, NO_TIME, False)
        out = []
        for e in pd.concat(list(batches)).sort_values("event_id").itertuples():
            held, problem = _judged(held, e.event_type, _micros(e.ts), phases, terminal)
            if problem:
                out.append((key[0], e.event_id, problem))
        state.update(held)
        if forget_ms:
            state.setTimeoutDuration(forget_ms)
        yield _violation_rows(out)

    timeout = "ProcessingTimeTimeout" if forget_ms else "NoTimeout"
    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, problem string", "rank int, last long, done boolean", "append", timeout)


def ordered_lifecycle_stream(events: DataFrame, delay: str = "10 minutes", slack_ms: int = 600_000, phases: dict[str, int] = EVENT_PHASES, terminal: int = TERMINAL, forget_ms: int | None = None) -> DataFrame:
    """Violations of a stream whose events of a key may come in any order, also over micro-batches.

    A key's events wait in its state, in order of ``event_id``. The foremost are judged once the
    watermark (``delay`` behind the latest time) is ``slack_ms`` past their times; an event-time timer
    wakes keys without new events. So results are those of ``violations``, as long as no event
    comes later than ``delay`` and none of a lower id has a time that is more than ``slack_ms`` later.
    Later events are dropped, as are those without a time. A key that has nothing waiting
    is forgotten ``forget_ms`` of event time after its last event, if that is given."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rank, last, done, waiting = state.get if state.exists else (NO_PHASE, NO_TIME, False, "[]")
        held, queue = (rank, last, done), [tuple(x) for x in json.loads(waiting)]
        if not state.hasTimedOut:
            for e in pd.concat(list(batches)).itertuples():
                queue.append((int(e.event_id), _micros(e.ts), None if pd.isna(e.event_type) else e.event_type))
            queue.sort(key=lambda x: x[:2])
        elif not queue:
            state.remove()
            return
        past, out = state.getCurrentWatermarkMs(), []
        while queue and queue[0][1] // 1000 + slack_ms <= past:
            event_id, time, kind = queue.pop(0)
            held, problem = _judged(held, kind, time, phases, terminal)
            if problem:
                out.append((key[0], event_id, problem))
        state.update((*held, json.dumps(queue)))
        if queue:  # later than the watermark, which is where the foremost is judged
            state.setTimeoutTimestamp(max(past, queue[0][1] // 1000 + slack_ms) + 1)
        elif forget_ms:
            state.setTimeoutTimestamp(max(past, held[1] // 1000 + forget_ms) + 1)
        yield _violation_rows(out)

    timed = events.where("ts is not null").withWatermark("ts", delay)
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, problem string", "rank int, last long, done boolean, waiting string", "append", "EventTimeTimeout")


def ingest_changed(stream: DataFrame, target: str, checkpoint: str, keys: list[str], order: str | None = None):
    """Writes each micro-batch of changed rows under its own id, so a batch that
    is delivered again overwrites itself; readers take the last row of each key. Of several rows of a key
    in a batch the last by ``order`` counts, without it the greatest by all columns."""

    def write(batch: DataFrame, epoch: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        last = F.max_by(F.struct(*rest), F.struct(*([order] if order else []), *rest)).alias("__last")
        batch.groupBy(*keys).agg(last).select(*[c if c in keys else F.col(f"__last.{c}").alias(c) for c in batch.columns]).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def observed_usage(calls: DataFrame, key: str, seq: str, estimated: str, actual: str, most: int = 7) -> DataFrame:
    """Calibration by key: the running weighted mean of actual over estimated
    tokens, weights up to ``most``, clamped to 0.5 and 3 (an ordered fold)."""
    ratio = F.least(F.greatest(F.col(actual) / F.col(estimated), F.lit(0.5)), F.lit(3.0))
    rows = calls.where((F.col(estimated) > 0) & (F.col(actual) > 0)).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(seq, ratio.alias("r")))).alias("u"))
    start = F.struct(F.lit(1.0).alias("c"), F.lit(0).alias("n"))

    def step(s, x):
        n = F.least(s["n"] + 1, F.lit(most))
        return F.struct((s["c"] + (x["r"] - s["c"]) / n).alias("c"), n.alias("n"))

    return rows.select(key, F.round(F.aggregate("u", start, step)["c"], 6).alias("calibration"))
