"""Expected results of operators that no query shows."""

from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import context, export, maintenance, ranking
from lorekeep.sources import records as R


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_pools_of_several_domains(spark):
    pools = spark.createDataFrame([("q", 1, 0.9, 0), ("q", 1, 0.2, 1), ("q", 2, 0.5, 0), ("q", 3, 0.5, 1), ("q", 4, 0.1, 1), ("r", 1, 0.3, 0)], "g string, id int, score double, ord int")
    got = export.merge_pools(pools, ["g"], "ord", 3).select("g", "id", "score", "rank")
    assert rows(got) == [("q", 1, 0.2, 3), ("q", 2, 0.5, 1), ("q", 3, 0.5, 2), ("r", 1, 0.3, 1)]
    assert export.merge_pools(pools, ["g"], "ord", 0).count() == 2  # one a group at least


def test_routing_of_entities(spark):
    pages = spark.createDataFrame([("d/a.md", "a"), ("d/b.md", "b"), ("d/c.md", "c"), ("d/e.md", "e")], "path string, stem string")
    entities = spark.createDataFrame([("a", "tool"), ("c", "secret")], "stem string, type string")
    guesses = spark.createDataFrame([("a", "person"), ("b", "person")], "stem string, type string")
    routed, rejected = maintenance.route_entities(pages, entities, guesses, spark.createDataFrame([("tool",), ("person",)], "type string"))
    assert rows(routed) == [("d/a.md", "tool"), ("d/b.md", "person")] and rows(rejected) == [("d/c.md",), ("d/e.md",)]


def test_merges_by_key(spark):
    current = spark.createDataFrame([("x", 0, "old"), ("y", 1, "old")], "k string, position int, v string")
    incoming = spark.createDataFrame([("z", 0, "new"), ("x", 1, "new")], "k string, position int, v string")
    assert rows(maintenance.merge_by_key(current, incoming, "k", "position")) == [("x", 0, "new"), ("y", 1, "old"), ("z", 2, "new")]
    stored = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, n int")
    changed, fresh = spark.createDataFrame([("a",)], "k string"), spark.createDataFrame([("a", 9), ("c", 1)], "k string, n int")
    assert rows(maintenance.replace_groups(stored, fresh, changed, "k")) == [("a", 9), ("b", 1)]


def test_rendered_chunks(spark):
    chunks = spark.createDataFrame([("q", 2, "p", "Head", "two"), ("q", 1, "p", None, None), ("r", 1, "s", "", "one")], "g string, pos int, article_id string, heading string, body string")
    got = dict((r.g, r.context) for r in context.render_chunks(chunks, ["g"], ["pos"]).collect())
    assert got == {"q": "### [[p]]\n\n\n### [[p]] — Head\ntwo", "r": "### [[s]]\none"}


def test_budgets_and_message_estimates(spark):
    df = spark.createDataFrame([(10_000, 2000), (10_000, 9000), (1, 1)], "window int, base int")
    got = [tuple(r.b) for r in df.select(context.resolve_budget(F.col("window"), F.col("base")).alias("b")).collect()]
    assert got == [(7000, 2000), (4500, 4500), (1, 1)]
    one = spark.createDataFrame([(["abcdefgh", ""], 2)], "m array<string>, n int").select(T.estimate_messages(F.col("m")).alias("a"), T.estimate_messages(F.col("m"), F.col("n")).alias("b"), T.estimate_messages(F.array().cast("array<string>")).alias("c")).first()
    assert tuple(one) == (1 + 4 + 0 + 4, 9 + 2 * 4096, 0)


def test_fused_lists_and_the_best_variant(spark):
    lists = lambda *x: spark.createDataFrame([("q", i, r) for i, r in x], "g string, id string, rank int")
    got = ranking.fuse_lexical(lists(("a", 1), ("b", 2)), lists(("b", 1), ("b", 3), ("c", 2)), ["g"], 2, extra=[lists(("c", 1))]).collect()
    assert [(r.id, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [("b", 1), ("c", 2)]
    variants = [("x", 0.9, 0.9, 0.95, True), ("y", 0.5, 0.6, 0.9, False), ("z", 0.99, 0.99, 0.5, False)]
    matrix = spark.createDataFrame(variants, "variant string, recall double, ndcg double, mrr double, any_boilerplate boolean")
    assert ranking.best_variant(matrix).first().variant == "y"
    assert ranking.best_variant(matrix.where("variant <> 'y'")).first().variant == "z"


def test_logs_of_evaluations(spark, tmp_path):
    schema = "runId string, n int, ratings map<string,string>, comment string"
    log = spark.createDataFrame([("r", 1, {"a": "up"}, None), ("r", 2, {"a": "up", "b": "down"}, None), ("s", 1, {}, "c")], schema)
    pick = lambda df: {(r.runId, r.n): (dict(r.ratings), r.comment) for r in df.collect()}
    assert pick(R.toggle_rating(log, "r", "a", "up", "n"))["r", 2][0] == {"b": "down"}
    assert pick(R.toggle_rating(log, "r", "a", "down", "n")) | {("r", 2): None} == pick(log) | {("r", 2): None}
    assert pick(R.toggle_rating(log, "r", "a", "down", "n"))["r", 2][0] == {"a": "down", "b": "down"}
    assert pick(R.set_comment(log, "r", "fine", "n")) == {("r", 1): ({"a": "up"}, None), ("r", 2): ({"a": "up", "b": "down"}, "fine"), ("s", 1): ({}, "c")}
    assert {(r.runId, r.n) for r in R.last_by_run(log, "n").collect()} == {("r", 2), ("s", 1)}
    for _ in range(2):
        R.append_log(log.select("runId", "n").where("n = 1"), f"{tmp_path}/log")
    assert rows(R.read_jsonl(spark, f"{tmp_path}/log", "runId string, n int")) == [("r", 1), ("r", 1), ("s", 1), ("s", 1)]


def test_long_runs_of_signs_are_measured(spark):
    """A million signs in a row, and every kind of character: counted as single characters would be."""
    texts = ["#" * 1_000_000, "7" * 300_000, "a" * 300_000 + "ж" * 7 + "字" * 5, "x\n\n-- 12 ?!\x0b\x0c\u2028\U0001f600\U0001f600 é 3.14\n", "", None]
    got = [tuple(r) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.measure_text(F.col("t")).alias("m")).orderBy("i").select(F.round("m.raw", 6), "m.bytes").collect()]
    raw = lambda cyr, cjk, word, symbols, runs: round(cyr / T.CYRILLIC_CHARS + cjk + word / T.WORD_CHARS + symbols / T.SYMBOL_CHARS + runs * T.RUN_TOKENS, 6)
    want = [raw(0, 0, 0, 10**6, 1), raw(0, 0, 0, 300_000, 1), raw(7, 5, 300_000, 0, 0), raw(0, 0, 7, 14, 10), raw(0, 0, 0, 0, 0), raw(0, 0, 0, 0, 0)]
    assert [g[0] for g in got] == want and [g[1] for g in got] == [len((t or "").encode()) for t in texts]
