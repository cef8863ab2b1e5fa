"""Choosing and packing context under a budget.

Greedy packing is a fold with a condition, so it is not a window sum: it runs
as ``aggregate`` over one query's short, sorted list of units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T


def greedy_pack(units: DataFrame, group: list[str], id_: str, cost: str, budget: Column | int, order: list[str]) -> DataFrame:
    """(*group, id, cost, kept, used) of each unit: in order, a unit enters if it
    still fits; one that does not is skipped and later smaller ones may follow.
    ``order`` names columns, sorted ascending (negate for the other way)."""
    limit = F.lit(budget).cast("long") if not isinstance(budget, Column) else budget.cast("long")
    rows = units.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(id_).alias("__id"), F.col(cost).cast("long").alias("__cost")))).alias("u"), F.first(limit).alias("__limit"))
    kind = units.schema[id_].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<id:{kind},cost:bigint,kept:boolean,used:bigint>>").alias("out"))

    def step(limit):
        def run(state, u):
            fits = state["used"] + u["__cost"] <= limit
            used = F.when(fits, state["used"] + u["__cost"]).otherwise(state["used"])
            return F.struct(used.alias("used"), F.array_append(state["out"], F.struct(u["__id"].alias("id"), u["__cost"].alias("cost"), fits.alias("kept"), used.alias("used"))).alias("out"))

        return run

    packed = rows.select(*group, F.explode(F.aggregate("u", start, step(F.col("__limit")))["out"]).alias("p"))
    return packed.select(*group, F.col("p.id").alias(id_), F.col("p.cost").alias("cost"), F.col("p.kept").alias("kept"), F.col("p.used").alias("used"))


def next_fit(units: DataFrame, group: list[str], id_: str, cost: str, budget: int, order: list[str]) -> DataFrame:
    """(*group, id, cost, batch): units in order fill batches; one that does not
    fit opens the next (an oversize unit has a batch of its own)."""
    rows = units.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(id_).alias("__id"), F.col(cost).cast("long").alias("__cost")))).alias("u"))
    kind = units.schema[id_].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("batch"), F.array().cast(f"array<struct<id:{kind},cost:bigint,batch:int>>").alias("out"))

    def step(state, u):
        opens = (state["used"] > 0) & (state["used"] + u["__cost"] > budget)
        batch = state["batch"] + F.when(opens, 1).otherwise(0)
        used = F.when(opens, u["__cost"]).otherwise(state["used"] + u["__cost"])
        return F.struct(used.alias("used"), batch.alias("batch"), F.array_append(state["out"], F.struct(u["__id"].alias("id"), u["__cost"].alias("cost"), batch.alias("batch"))).alias("out"))

    packed = rows.select(*group, F.explode(F.aggregate("u", start, step)["out"]).alias("p"))
    return packed.select(*group, F.col("p.id").alias(id_), F.col("p.cost").alias("cost"), F.col("p.batch").alias("batch"))


def pack_context(required: DataFrame, units: DataFrame, group: list[str], id_: str, cost: str, budget: int, order: list[str]) -> DataFrame:
    """Greedy packing after ``required(cost)`` of each group is paid for; groups
    whose required part alone exceeds the budget keep nothing."""
    paid = required.groupBy(*group).agg(F.sum("cost").alias("__paid"))
    left = units.join(paid, group, "left").withColumn("__left", F.lit(budget) - F.coalesce("__paid", F.lit(0)))
    packed = greedy_pack(left, group, id_, cost, F.col("__left"), order)
    over = paid.where(F.col("__paid") > budget).select(*group, F.lit(True).alias("__over"))
    return packed.join(over, group, "left").withColumn("kept", F.col("kept") & F.col("__over").isNull()).drop("__over")


def dedupe_chunks(chunks: DataFrame, group: list[str], score: str, position: str, heading: str = "heading", body: str = "body") -> DataFrame:
    """Of chunks with one normalised key the best scored (first on ties), at the
    place where the key was first seen (``position`` is overwritten)."""
    keyed = chunks.withColumn("__k", T.chunk_key(F.col(heading), F.col(body)))
    w = Window.partitionBy(*group, "__k")
    best = keyed.withColumns({"__r": F.row_number().over(w.orderBy(F.col(score).desc(), position)), "__p": F.min(position).over(w)})
    return best.where("__r = 1").withColumn(position, F.col("__p")).drop("__k", "__r", "__p")


def anchors(ranked: DataFrame, group: list[str], article: str, limit: int) -> DataFrame:
    """``ranked(rank)`` with ``anchor``: the first row of each of the first
    ``limit - limit / 3`` distinct articles of a group."""
    w = Window.partitionBy(*group)
    capped = ranked.withColumn("__n", F.least(F.lit(limit), F.count(F.lit(1)).over(w)))
    first = capped.withColumn("__f", F.row_number().over(Window.partitionBy(*group, article).orderBy("rank")) == 1)
    nth = first.withColumn("__a", F.sum(F.col("__f").cast("int")).over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    slots = F.col("__n") - F.floor(F.col("__n") / 3)
    return nth.withColumn("anchor", F.col("__f") & (F.col("__a") <= slots)).drop("__n", "__f", "__a")


def select_context(ranked: DataFrame, group: list[str], article: str, question: str, limit: int, heading: str = "heading", body: str = "body") -> DataFrame:
    """The context of each question from its short ranked list: anchors of distinct
    articles, then chunks for question words not covered yet, then siblings of
    anchors, then the rest. ``place`` is the new order. Choices depend on earlier
    ones, so a group is one grouped map; token sets are computed before it."""
    tokens = ranked.withColumns({"__facets": T.token_set(F.concat_ws("\n", T.text_or_empty(F.col(heading)), T.text_or_empty(F.col(body)))), "__asked": T.token_set(F.col(question))})
    fields = [f for f in ranked.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", place int"

    def choose(pdf):
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        articles, facets = pdf[article].tolist(), [set(x) for x in pdf["__facets"]]
        room = min(limit, len(pdf))
        siblings = room // 3
        seen, order = set(), []
        for i, a in enumerate(articles):
            if len(seen) >= room - siblings:
                break
            if a not in seen:
                seen.add(a)
                order.append(i)
        taken, spent = set(order), 0
        for word in pdf["__asked"].iloc[0] if len(pdf) else []:
            if len(taken) >= room or spent >= siblings:
                break
            if any(word in facets[i] for i in order):
                continue
            i = next((i for i in range(len(pdf)) if i not in taken and word in facets[i]), None)
            if i is not None:
                taken.add(i)
                order.append(i)
                spent += 1
        for pool in (lambda a: a in seen, lambda a: True):
            for i, a in enumerate(articles):
                if len(taken) >= room:
                    break
                if i not in taken and pool(a):
                    taken.add(i)
                    order.append(i)
        out = pdf.iloc[order].copy()
        out["place"] = range(1, len(out) + 1)
        return out[[f.name for f in fields] + ["place"]]

    return tokens.groupBy(*group).applyInPandas(choose, schema)


def history_units(chat: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """Turns before the last user turn in units: a user turn with the assistant's
    reply, or a turn alone. (conv, turn, role, unit, current): ``unit`` is the
    first turn's position, and the current user turn is flagged; later turns have none."""
    w = Window.partitionBy(conversation).orderBy(turn)
    numbered = chat.withColumn("__i", F.row_number().over(w) - 1)
    current = F.max(F.when(F.col(role) == "user", F.col("__i"))).over(Window.partitionBy(conversation))
    placed = numbered.withColumns({"__c": current, "__before": F.lag(role).over(w)})
    # A reply joins the user turn before it; both stand before the current turn.
    joins = (F.col(role) == "assistant") & (F.col("__before") == "user") & (F.col("__i") < F.col("__c"))
    unit = F.when(F.col("__i") < F.col("__c"), F.col("__i") - F.when(F.coalesce(joins, F.lit(False)), 1).otherwise(0))
    return placed.withColumns({"unit": unit.cast("long"), "current": F.coalesce(F.col("__i") == F.col("__c"), F.lit(False))}).drop("__i", "__c", "__before")


def pack_history(chat: DataFrame, budget: int, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Keeps each conversation's current user turn, then its newest units that
    fit: (conv, unit, cost, kept). Conversations without a user turn have no rows."""
    units = history_units(chat, conversation, turn, role)
    cost = T.estimate_tokens(F.concat_ws(": ", role, T.text_or_empty(F.col(text)))) + T.MESSAGE_TOKENS
    required = units.where("current").select(conversation, cost.alias("cost"))
    older = units.where("unit is not null").groupBy(conversation, "unit").agg(F.sum(cost).alias("cost")).withColumn("newest", -F.col("unit"))
    return pack_context(required, older, [conversation], "unit", "cost", budget, ["newest"]).select(conversation, "unit", "cost", "kept")


def shrink_budget(budget: Column, prompt: Column, most: Column) -> Column:
    """The next budget after an overflow: in proportion with a tenth off where
    the counts are known, else three quarters; smaller by one at least."""
    known = (prompt > 0) & (most > 0) & (most < prompt)
    smaller = F.when(F.coalesce(known, F.lit(False)), F.floor(budget * most / prompt * 0.9)).otherwise(F.floor(budget * 0.75))
    return F.when(budget <= 1, budget).otherwise(F.greatest(F.lit(1), F.least(budget - 1, smaller)))


def resolve_budget(window: Column, output_base: Column, safety: float = 0.9, output_share: float = 0.5) -> Column:
    """struct<input, output> token budgets of a context window."""
    usable = F.floor(window * safety)
    output = F.least(output_base, F.floor(usable * output_share))
    return F.struct(F.greatest(F.lit(1), usable - output).cast("long").alias("input"), F.greatest(F.lit(1), output).cast("long").alias("output"))


def render_chunks(chunks: DataFrame, group: list[str], order: list[str], heading: str = "heading", body: str = "body", article: str = "article_id") -> DataFrame:
    """One text a group: chunks in order under their headings."""
    one = F.concat(F.lit("### [["), F.col(article).cast("string"), F.lit("]]"), F.when(F.coalesce(F.col(heading), F.lit("")) != "", F.concat(F.lit(" — "), F.col(heading))).otherwise(F.lit("")), F.lit("\n"), T.text_or_empty(F.col(body)))
    return chunks.groupBy(*group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, one.alias("__t")))), lambda x: x["__t"]), "\n\n").alias("context"))
