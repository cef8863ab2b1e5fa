import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import evaluated
from lorekeep.operators.evaluated import TooLarge


def test_search_by_halves(spark):
    rng = random.Random(1)
    groups = [(i, f"g{i}", rng.randrange(1, 50), rng.randrange(60, 5000)) for i in range(40)] + [(90, None, 1, 1000), (91, "empty", 10, 9), (92, "one", 5, 5), (93, "none", 1, 100)]
    bounds = {name: (rng.randrange(1, 900), rng.randrange(900, 4000)) for _, name, _, _ in groups} | {"none": (200, 100), "one": (5, 5)}

    def verdict(name, b):
        low, high = bounds[name]
        return "too small" if b < low else "too large" if b > high else "feasible"

    asked = []

    def evaluate(df):
        rows = [(r.name, r.budget, verdict(r.name, r.budget)) for r in df.collect()]
        asked.append(len(rows))
        return spark.createDataFrame(rows, "name string, budget long, verdict string")

    df = spark.createDataFrame(groups, "id int, name string, low int, high int")
    got = {r.name: r for r in evaluated.search_budgets(df, ["name"], evaluate).collect()}
    for _, name, low, high in groups:
        want = [b for b in range(low, high + 1) if verdict(name, b) == "feasible"]
        assert got[name].budget == (max(want) if want else None), name
        assert got[name].evaluations <= math.ceil(math.log2(max(1, high - low + 1) + 1))
    assert got["empty"].evaluations == 0 and len(asked) <= 13
    assert evaluated.search_budgets(df.where("id < 0"), ["name"], evaluate).count() == 0


def test_repacks_stop_after_two(spark):
    limits = {1: 10_000, 2: 700, 3: 500, 4: 1, 5: 0}

    def execute(df):
        limit = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("id"))
        outcome = F.when(F.col("id") == 5, "refused").when(F.col("budget") <= limit, "ok").otherwise("overflow")
        return df.select("id", "budget", outcome.alias("outcome"), F.when(F.col("id") == 3, F.col("budget")).alias("prompt"), F.when(F.col("id") == 3, limit).alias("most"))

    df = spark.createDataFrame([(i, 1000) for i in limits], "id int, budget int")
    got = sorted((r.id, r.attempt, r.budget, r.outcome, r.next) for r in evaluated.repacked(df, ["id"], execute).collect())
    assert got == [
        (1, 0, 1000, "ok", None),
        (2, 0, 1000, "overflow", 750), (2, 1, 750, "overflow", 562), (2, 2, 562, "ok", None),
        (3, 0, 1000, "overflow", 450), (3, 1, 450, "ok", None),
        (4, 0, 1000, "overflow", 750), (4, 1, 750, "overflow", 562), (4, 2, 562, "overflow", None),
        (5, 0, 1000, "refused", None),
    ]


def test_batches_are_halved_where_the_call_fails(spark):
    rows = [(b, i, (i * 7919 + b) % 50) for b in range(6) for i in range(17)] + [(9, 0, 500)]

    def call(part):
        if part["size"].sum() > 120:
            raise TooLarge(f"{part['size'].sum()} is too much")
        return pd.DataFrame({"total": [int(part["size"].sum())] * len(part)})

    want = []

    def halve(part):
        total = sum(r[2] for r in part)
        if total <= 120:
            return 1, [(*r, total, len(part), None) for r in part]
        if len(part) == 1:
            return 1, [(*part[0], None, 1, f"{total} is too much")]
        m = math.ceil(len(part) / 2)
        (n, a), (k, b) = halve(part[:m]), halve(part[m:])
        return 1 + n + k, a + b

    for b in {r[0] for r in rows}:
        n, out = halve(sorted(r for r in rows if r[0] == b))
        want += [(*r[:5], n, r[5]) for r in out]
    df = spark.createDataFrame(rows, "b int, i int, size int").repartition(4)
    got = evaluated.split_on_failure(df, ["b"], ["i"], call, "total long").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert evaluated.split_on_failure(df.where("b < 0"), ["b"], ["i"], call, "total long").count() == 0


def test_other_failures_are_not_swallowed(spark):
    def call(part):
        raise ValueError("something else")

    with pytest.raises(Exception, match="something else"):
        evaluated.split_on_failure(spark.range(3).withColumn("b", F.lit(1)), ["b"], ["id"], call, "x long").collect()


@pytest.mark.parametrize("width", [1024, 8])
def test_reduction_by_levels(spark, width):
    rng = random.Random(width)
    budget = 60
    packets = [(f"e{e}", p, [f"f{rng.randrange(12)}" for _ in range(rng.randrange(1, 4))]) for e in range(8) for p in rng.sample(range(90), rng.choice([1, 3, 20, 60]))]
    packets += [("many", p, [f"x{p}" + "y" * 20]) for p in range(12)] + [("large", 0, ["z" * 90]), ("large", 1, ["a"]), ("none", 3, [])]
    price = lambda facts: 2 + sum(map(len, facts))
    names = sorted({p[0] for p in packets})
    units = {n: sorted((p, f) for e, p, f in packets if e == n) for n in names}
    want, batches, level = {}, [], 0
    while units:
        found, widest = {}, 0
        for n, us in units.items():
            cut = []
            for p, f in us:
                s = p // width
                if not cut or cut[-1][0] != s or (sum(price(x) for x in cut[-1][2]) > 0 and sum(price(x) for x in cut[-1][2]) + price(f) > budget):
                    cut.append([s, cut[-1][1] + 1 if cut and cut[-1][0] == s else 0, []])
                cut[-1][2].append(f)
            found[n] = cut
            widest = max(widest, *(c[1] for c in cut))
        nxt = {}
        for n, cut in found.items():
            batches += [(level, n, s * (widest + 1) + b, len(us), sum(map(price, us))) for s, b, us in cut]
            merged = [(s * (widest + 1) + b, list(dict.fromkeys(x for f in us for x in f))) for s, b, us in cut]
            if any(price(f) > budget for _, _, us in cut for f in us):
                want[n] = (None, level, "oversize")
            elif len(cut) == 1:
                want[n] = (merged[0][1], level, "reduced")
            elif len(cut) == len(units[n]):
                want[n] = (None, level, "stuck")
            elif level >= 8:
                want[n] = (None, level, "deep")
            else:
                nxt[n] = merged
        units, level = nxt, level + 1
    df = spark.createDataFrame(packets, "e string, p int, facts array<string>").repartition(3)
    cost = lambda c: F.lit(2) + F.aggregate(c, F.lit(0), lambda s, x: s + F.length(x))
    out, report = evaluated.reduce_tree(df, "e", "p", "facts", cost, budget, width=width)
    assert {r.e: (r.facts, r.depth, r.status) for r in out.collect()} == want
    assert sorted(tuple(r) for r in report.collect()) == sorted(batches)
    assert {s for _, _, s in want.values()} >= {"reduced", "oversize", "stuck"}
    none = evaluated.reduce_tree(df.where("p < 0"), "e", "p", "facts", cost, budget)
    assert none[0].count() == 0 and none[1].count() == 0


def test_depth_is_bounded(spark):
    df = spark.createDataFrame([("e", p, [f"f{p % 3}"]) for p in range(64)], "e string, p int, facts array<string>")
    cost = lambda c: F.lit(1)
    out, report = evaluated.reduce_tree(df, "e", "p", "facts", cost, 2, most_depth=3)
    assert [tuple(r) for r in out.collect()] == [("e", None, 3, "deep")]
    assert sorted((r.level, r.n) for r in report.groupBy("level").agg(F.count("*").alias("n")).collect()) == [(0, 32), (1, 16), (2, 8), (3, 4)]
