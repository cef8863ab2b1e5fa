"""Operators that ask an evaluator: searches by halves, repacking, splitting on failure.

An evaluator is a function of DataFrames (one job answers every open group at once) or, where
a call itself can fail, of a pandas frame inside a task. State is written between steps,
so a step is never evaluated twice and a lost executor costs one step.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.context import next_fit, shrink_budget
from lorekeep.storage import materialise, ship

MOST_REPACKS, MOST_DEPTH, SLICE = 2, 8, 1024


def search_budgets(groups: DataFrame, key: list[str], evaluate: Callable[[DataFrame], DataFrame], low: str = "low", high: str = "high") -> DataFrame:
    """(*key, budget, evaluations): the largest feasible budget of each group within ``low``
    to ``high`` (null without one), and how many budgets were judged to find it.

    ``evaluate`` gets (*key, budget), one row an open group, and returns these with a ``verdict``:
    ``too small``, ``too large`` or ``feasible``, monotone in the budget. Each step
    halves the intervals of all groups in one job. A group whose interval is empty asks nothing;
    one without an answer counts as too large."""
    long = lambda c: F.col(c).cast("long")
    state = groups.select(*key, long(low).alias("low"), long(high).alias("high"), F.lit(None).cast("long").alias("best"), F.lit(0).cast("long").alias("evaluations"))
    state = materialise(state, "budget-search")
    widest = state.agg(F.max(F.col("high") - F.col("low") + 1)).first()[0] or 0
    middle = F.col("low") + F.floor((F.col("high") - F.col("low")) / 2)
    for _ in range(max(0, widest).bit_length()):
        judged = evaluate(state.where("low <= high").select(*key, middle.alias("budget"))).select(*key, "budget", "verdict")
        kept = [F.col(f"s.{k}").alias(k) for k in key]
        met = state.alias("s").join(judged.alias("j"), [F.col(f"s.{k}").eqNullSafe(F.col(f"j.{k}")) for k in key], "left").where("low > high or budget is null or budget = low + floor((high - low) / 2)")
        open_, good = F.col("low") <= F.col("high"), F.col("verdict") == "feasible"
        up = F.coalesce(good | (F.col("verdict") == "too small"), F.lit(False))
        state = materialise(
            met.select(
                *kept,
                F.when(open_ & up, middle + 1).otherwise(F.col("low")).alias("low"),
                F.when(open_ & ~up, middle - 1).otherwise(F.col("high")).alias("high"),
                F.when(open_ & F.coalesce(good, F.lit(False)), middle).otherwise(F.col("best")).alias("best"),
                (F.col("evaluations") + open_.cast("long")).alias("evaluations"),
            ),
            "budget-search",
        )
    return state.select(*key, F.col("best").alias("budget"), "evaluations")


def repacked(requests: DataFrame, key: list[str], execute: Callable[[DataFrame], DataFrame], budget: str = "budget") -> DataFrame:
    """(*key, attempt, budget, outcome, next): every attempt at each request.

    ``execute`` gets (*key, budget) and returns these with an ``outcome`` (``ok``, ``overflow`` or
    another failure) and, of an overflow, the counts ``prompt`` and ``most`` where they are known.
    An overflow is tried again with the budget that ``shrink_budget`` gives, at most
    ``MOST_REPACKS`` times and not below 1; ``next`` is null after the last attempt."""
    open_, attempts = requests.select(*key, F.col(budget).cast("long").alias("budget")), []
    for n in range(MOST_REPACKS + 1):
        tried = execute(open_).select(*key, "budget", "outcome", F.col("prompt").cast("long").alias("prompt"), F.col("most").cast("long").alias("most"))
        again = (F.col("outcome") == "overflow") & (F.col("budget") > 1) & F.lit(n < MOST_REPACKS)
        smaller = shrink_budget(F.col("budget"), F.col("prompt"), F.col("most")).cast("long")
        done = materialise(tried.select(*key, F.lit(n).alias("attempt"), "budget", "outcome", F.when(again, smaller).alias("next")), "repack")
        attempts.append(done)
        open_ = done.where("next is not null").select(*key, F.col("next").alias("budget"))
    out = attempts[0]
    for a in attempts[1:]:
        out = out.unionByName(a)
    return out


class TooLarge(Exception):
    """What a call raises when its batch must be halved."""


def split_on_failure(items: DataFrame, batch: list[str], order: list[str], call: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows of ``items`` with what ``call`` returns for them, (*items, *schema, part, calls, error).

    ``call`` gets the rows of a batch in order and returns a frame of as many rows with the
    columns of ``schema``. Where it raises ``TooLarge`` the batch is halved (the larger
    half first) on a stack inside the task, and the halves are called. A single row that
    still fails is returned with the ``error`` and null results. Any other exception fails
    the task. ``part`` is the size of the part that a row was answered in, ``calls`` how
    many calls its whole batch took. Batches must be of a bounded size."""
    ship(items.sparkSession)
    given = [f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields]
    names = [c.strip().split()[0].strip("`") for c in schema.split(",")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable", na_position="first").reset_index(drop=True)
        stack, out, calls = [(0, len(rows))], [], 0
        while stack:
            low, high = stack.pop()
            part = rows.iloc[low:high].reset_index(drop=True)
            calls += 1
            try:
                answer = call(part)
                if len(answer) != len(part):
                    raise ValueError(f"{len(answer)} answers to {len(part)} rows")
                out.append(pd.concat([part, answer.reset_index(drop=True)[names].astype(object)], axis=1).assign(part=len(part), error=None))
            except TooLarge as e:
                if len(part) == 1:
                    out.append(part.assign(**{n: None for n in names}, part=1, error=str(e)))
                else:
                    middle = low + -(-(high - low) // 2)
                    stack += [(middle, high), (low, middle)]
        return pd.concat(out).assign(calls=calls)[[*rows.columns, *names, "part", "calls", "error"]]

    return items.groupBy(*batch).applyInPandas(run, ", ".join([*given, schema, "part int", "calls int", "error string"]))


def reduce_tree(packets: DataFrame, entity: str, position: str, facts: str, cost: Callable[[Column], Column], budget: int, most_depth: int = MOST_DEPTH, width: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """Reduces the packets of each entity, level by level, to one list of distinct facts in order.

    Each level packs an entity's units in order into batches whose units cost at most ``budget``
    together, and merges each batch into one unit, which ``cost(facts)`` prices anew. Batches stay
    within slices of ``width`` positions (not negative, distinct within an entity; packets of no
    entity take no part), so no task holds more of an entity than a slice, however many packets it has.

    Returns (entity, facts, depth, status) and (level, entity, position, units, cost), one row a
    batch. Depth is the number of levels that were merged before one batch held all. The status is
    ``reduced``; ``oversize`` where a unit alone exceeds the budget; ``stuck`` where a level has
    as many batches as units; ``deep`` where ``most_depth`` levels did not suffice. Facts
    are null unless reduced."""
    units = packets.where(F.col(entity).isNotNull()).select(entity, F.col(position).cast("long").alias("position"), F.col(facts).alias("facts"))
    units = materialise(units.withColumn("cost", cost(F.col("facts")).cast("long")), "reduce-units")
    done, levels, level = [], [], 0
    while True:
        named = units.withColumn("slice", F.floor(F.col("position") / width))
        dealt = next_fit(named, [entity, "slice"], "position", "cost", budget, ["position"]).select(entity, "slice", "position", "batch")
        placed = materialise(named.join(dealt, [entity, "slice", "position"]), "reduce-level")
        batches = placed.groupBy(entity, "slice", "batch").agg(
            F.count(F.lit(1)).alias("units"), F.sum("cost").alias("paid"), F.max("cost").alias("largest"), F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("position", "facts"))), lambda x: x["facts"]))).alias("facts")
        )
        widest = placed.agg(F.max("batch")).first()[0]
        if widest is None:
            break
        # Slices follow each other as closely as the fullest allows, so their order stays.
        merged = materialise(batches.withColumn("position", F.col("slice") * (widest + 1) + F.col("batch")), "reduce-batches")
        levels.append(merged.select(F.lit(level).alias("level"), entity, "position", "units", F.col("paid").alias("cost")))
        state = merged.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.sum("units").alias("m"), F.max("largest").alias("largest"))
        status = F.when(F.col("largest") > budget, "oversize").when(F.col("n") == 1, "reduced").when(F.col("n") == F.col("m"), "stuck").when(F.lit(level >= most_depth), "deep")
        state = materialise(state.select(entity, status.alias("status")), "reduce-state")
        one = merged.select(entity, "facts").join(state.where("status = 'reduced'"), entity)
        failed = state.where("status <> 'reduced'").select(entity, F.lit(None).cast(units.schema["facts"].dataType).alias("facts"), "status")
        done.append(one.unionByName(failed).select(entity, "facts", F.lit(level).alias("depth"), "status"))
        left = merged.join(state.where("status is null").select(entity), entity)
        if left.isEmpty():
            break
        units = materialise(left.select(entity, "position", "facts", cost(F.col("facts")).cast("long").alias("cost")), "reduce-units")
        level += 1
    if not done:
        none = units.sparkSession.createDataFrame([], packets.select(F.lit(0).alias("level"), entity, F.lit(0).cast("long").alias("position"), F.lit(0).cast("long").alias("units"), F.lit(0).cast("long").alias("cost")).schema)
        return units.select(entity, "facts", F.lit(0).alias("depth"), F.lit("").alias("status")), none
    out, report = done[0], levels[0]
    for d, r in zip(done[1:], levels[1:]):
        out, report = out.unionByName(d), report.unionByName(r)
    return out, report
