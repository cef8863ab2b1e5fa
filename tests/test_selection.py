import random

from pyspark.sql import functions as F

from lorekeep.operators import export, selection


def slots(fused, pages, chunks, legacy, limit):
    """The constraints of ``fixed_slots`` by plain loops."""
    top = list(dict.fromkeys(fused))[:limit]
    p, c, old = pages[:limit], set(chunks[:limit]), set(legacy[:limit])

    def put(x, taken):
        for i in reversed(range(len(top))):
            if x not in top and not taken(top[i]):
                top[i] = x

    for i, x in enumerate(p):
        put(x, (lambda y: y in p or y in old) if x in old else (lambda y, i=i: y in p or y in c or (y in old and i >= 2)))
    for x in chunks[: min(3, limit)]:
        put(x, lambda y: y in p[:3] or y in chunks[:4])
    return list(dict.fromkeys(top))[:limit]


def test_fixed_slots(spark):
    rng = random.Random(3)
    rows = [(k, *[[rng.randrange(25) for _ in range(rng.randrange(1, 14))] for _ in range(4)]) for k in range(200)]
    rows = [(k, f, *(list(dict.fromkeys(x)) for x in rest)) for k, f, *rest in rows]
    df = spark.createDataFrame(rows, "k int, fused array<int>, pages array<int>, chunks array<int>, legacy array<int>")
    for limit in (1, 3, 8):
        got = {}
        for r in selection.fixed_slots(df, ["k"], limit).orderBy("k", "slot").collect():
            got.setdefault(r.k, []).append(r.id)
        assert got == {k: slots(*lists, limit) for k, *lists in rows}


def test_entity_context_without_target(spark):
    rows = [(1, "a", 0, 2.0, "Same  text", 5), (1, "b", 0, 3.0, "same text", 5), (1, "b", 1, 1.0, "x", 90), (1, "a", 1, 1.0, "y", 4)]
    df = spark.createDataFrame(rows, "q int, page string, pos int, score double, body string, size int")
    got = [tuple(r) for r in selection.entity_context(df, ["q"], "page", "pos", "score", "body", "size", 10).orderBy("round", "page").collect()]
    assert got == [(1, "a", 1, 4, True, 9, 1), (1, "b", 0, 5, True, 5, 1), (1, "b", 1, 90, False, 9, 2)]


def test_halves_and_single_units(spark):
    df = spark.createDataFrame([(1, [5, 5, 50, 5]), (2, [1]), (3, [200]), (4, [])], "k int, c array<long>")
    got = sorted(tuple(r) for r in selection.halved(df, ["k"], "c", 20).collect())
    assert got == [(1, 0, 2, 10), (1, 2, 3, 50), (1, 3, 4, 5), (2, 0, 1, 1), (3, 0, 1, 200), (4, 0, 0, 0)]


def test_retry_delay_has_a_ceiling(spark):
    df = spark.createDataFrame([(1, None, 0.0), (1, None, 1.0), (10, None, 1.0), (2, 60000.0, 0.0), (3, -1.0, 2.0), (0, None, -1.0)], "n int, h double, j double")
    assert [r.d for r in df.select(export.retry_delay(F.col("n"), F.col("h"), F.col("j")).alias("d")).collect()] == [375, 500, 8000, 8000, 2000, 375]


def test_tokens_and_tags(spark):
    df = spark.createDataFrame([(" 'a b' ", ["#A b", "a-b", "x/y", "", None])], "t string, g array<string>")
    assert tuple(df.select(selection.source_token(F.col("t")), selection.export_tags(F.col("g"))).first()) == ("a b", ["a-b", "x-y"])
