from pyspark.sql import functions as F

from lorekeep.operators import integrity


def test_titles_and_sources(spark):
    pages = spark.createDataFrame([("a", " Alpha ", None, 1), ("b", "", "Beta", 2), ("c", "alpha", None, 3), ("d", None, None, 4)], "stem string, title string, h1 string, pos int")
    titles = integrity.title_map(pages)
    assert {r.title: r.stem for r in titles.collect()} == {"alpha": "c", "beta": "b"}
    entries = spark.createDataFrame([("p", 1, "a"), ("p", 2, "BETA"), ("p", 3, "nope"), ("p", 4, "page")], "path string, pos int, entry string")
    stems, own = spark.createDataFrame([("a",), ("b",)], "stem string"), spark.createDataFrame([("page",)], "stem string")
    rows = {r.pos: (r.entry, r.status) for r in integrity.checked_sources(entries, stems, titles, own).collect()}
    assert rows == {1: ("a", "kept"), 2: ("b", "renamed"), 3: ("nope", "dropped"), 4: ("page", "dropped")}


def test_related_sections(spark):
    items = spark.createDataFrame([(1, "solar panel power", 5), (2, "solar panel solar", 9), (3, "wind", 2), (4, "solar", 4)], "id int, text string, cost int")
    submitted = items.where("id = 1").select(F.lit(0).alias("batch"), "id", "text")
    rows = {r.id: r.kept for r in integrity.related_sections(items, submitted, 10).collect()}
    assert rows == {2: True, 4: False}


def test_actions_and_reductions(spark):
    pages = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string")
    actions = spark.createDataFrame([("create", "a", None), ("patch", "b", "0"), ("patch", "c", "1"), ("create", "d", None), ("create", "d", None)], "action string, path string, hash string")
    assert {(r.path, r.problem) for r in integrity.action_problems(actions, pages).collect()} == {("a", "page exists"), ("b", "stale page"), ("c", "page does not exist"), ("d", "duplicate path")}
    a = spark.createDataFrame([("e", "fact", "x"), ("e", "fact", "y")], "entity string, field string, value string")
    b = spark.createDataFrame([("e", "fact", "y"), ("e", "fact", "z")], "entity string, field string, value string")
    assert {(r.value, r.problem) for r in integrity.reduction_problems(a, b).collect()} == {("x", "lost"), ("z", "made up")}
    packets = spark.createDataFrame([(1, "e", 1, 3), (1, "e", 4, 9)], "chunk int, entity string, start int, end int")
    chunks = spark.createDataFrame([(1, 11, 15)], "chunk int, first_line int, last_line int")
    assert {(r.start, r.end, r.valid) for r in integrity.global_ranges(packets, chunks).collect()} == {(11, 13, True), (14, 19, False)}
    found = spark.createDataFrame([(1, "a", False, None, 1), (1, "b", True, None, 2), (1, "c", False, 1, 3)], "q int, id string, seed boolean, fused_rank int, pos int")
    assert [r.id for r in integrity.context_pages(found, ["q"], 2).orderBy("place").collect()] == ["c", "b"]
