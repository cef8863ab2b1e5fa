import json

import pytest
from pyspark.sql import functions as F

from lorekeep.sources import records as R
from lorekeep.streaming import lifecycle as L


def page(**more):
    return {"kind": "page", "schemaVersion": 1, "articleId": "a", "path": "p", "type": "t", "description": "d", "resource": [], "bodyHash": "x", "descriptionHash": "y", **more}


def chunk(**more):
    return {"kind": "chunk", "schemaVersion": 1, "articleId": "a", "path": "p", "heading": "", "ordinal": 0, "bodyHash": "x", "embedTextHash": "e", "vector": [1.0, 2.0], "vectorModel": "m", "dimensions": 2, "updatedAt": "now", **more}


def test_index_records(spark, tmp_path):
    path = f"{tmp_path}/index.jsonl"
    rows = [page(), page(schemaVersion=2), chunk(), chunk(dimensions=3), chunk(ordinal=-1), {"kind": "other", "z": 1}]
    with open(path, "w") as f:
        f.write("\n".join(map(json.dumps, rows)) + "\n\n")
    pages, chunks, others = R.split_index(R.read_index(spark, path))
    assert (pages.count(), chunks.count()) == (1, 1) and json.loads(others.first().value) == {"kind": "other", "z": 1}
    assert R.invalid_index_rows(R.read_index(spark, path)).count() == 3
    assert R.read_index(spark, f"{tmp_path}/none.jsonl").count() == 0
    assert R.vector_cache(chunks, "m", 2).first().chunks[0].vector == [1.0, 2.0]


def test_jsonl_is_strict(spark, tmp_path):
    path = f"{tmp_path}/x.jsonl"
    with open(path, "w") as f:
        f.write('{"a": 1}\n\n{bad\n')
    with pytest.raises(Exception):
        R.read_jsonl(spark, path, "a int").collect()
    assert [r.a for r in R.read_jsonl(spark, path, "a int", strict=False).collect() if r._corrupt_record is None] == [1]


def test_pages_and_logs(spark, tmp_path):
    (tmp_path / "w" / "sub").mkdir(parents=True)
    (tmp_path / "w" / "sub" / "one.md").write_text("# One\n[[x]]\n")
    (tmp_path / "w" / "_index.md").write_text("x")
    rows = R.page_rows(R.read_pages(spark, f"{tmp_path}/w")).collect()
    assert [(r.path.rsplit("/", 1)[-1], r.content) for r in rows] == [("one.md", "# One\n[[x]]\n")]
    log = spark.createDataFrame([("a", "2024-01-02 10:00 first\n---\n\n---\nno time\n")], "domain string, content string")
    assert [(r.pos, r.timestamp) for r in R.legacy_log_blocks(log).orderBy("pos").collect()] == [(0, "2024-01-02 10:00"), (2, None)]


def test_metadata_round_trip(spark):
    rows = spark.createDataFrame(
        [("domain", "d", "Name", "f", ["s"], None, None, None, None), ("entity_type", "d", None, None, None, "t1", 1, None, None), ("entity_type", "d", None, None, None, "t0", 0, None, None), ("source_state", "d", None, None, None, None, None, "p", "h")],
        "kind string, id string, name string, wikiFolder string, sourcePaths array<string>, type string, position int, path string, hash string",
    )
    for c, t in (("description", "string"), ("extractionCues", "array<string>"), ("minMentionsForPage", "int"), ("wikiSubfolder", "string")):
        rows = rows.withColumn(c, F.lit(None).cast(t))
    one = R.fold_metadata(rows)
    first = one.first()
    assert [t.type for t in first.entityTypes] == ["t0", "t1"] and first.analyzedSources == {"p": "h"}
    assert R.unfold_metadata(one).groupBy("kind").count().count() == 3


def test_ratings(spark):
    rows = spark.createDataFrame([("r", 1, {"a": "up"}), ("r", 2, {"a": "up"})], "runId string, seq int, ratings map<string,string>")
    assert [r.ratings for r in R.toggle_rating(rows, "r", "a", "up", "seq").orderBy("seq").collect()] == [{"a": "up"}, {}]
    assert R.toggle_rating(rows, "r", "b", "down", "seq").orderBy("seq").collect()[1].ratings == {"a": "up", "b": "down"}


def test_service_connector(spark):
    rows = spark.range(250).withColumn("t", F.lit("x"))
    out = R.call_service(rows, "id long, n int", lambda batch: [{"id": r["id"], "n": len(batch)} for r in batch])
    assert out.count() == 250 and out.agg(F.max("n")).first()[0] <= 100


EVENTS = [(1, 1, "2024-01-01 00:00:00", "signup"), (1, 2, "2024-01-01 00:01:00", "click"), (1, 3, "2024-01-01 00:02:00", "view"), (1, 4, "2024-01-01 00:03:00", "purchase"), (1, 5, "2024-01-01 00:04:00", "error"), (2, 6, "2024-01-01 00:05:00", "view"), (2, 7, "2024-01-01 00:04:00", "view")]
# Before 1970, of a kind without a phase, and without a time.
EVENTS += [(3, 8, "1969-01-01 00:00:00", "click"), (3, 9, "1969-01-01 00:01:00", "hover"), (3, 10, None, "view"), (3, 11, "1968-01-01 00:00:00", "purchase"), (3, 12, "1968-01-01 00:00:00", "hover")]


def events(spark):
    return spark.createDataFrame(EVENTS, "user_id long, event_id long, t string, event_type string").select("user_id", "event_id", F.to_timestamp("t").alias("ts"), "event_type", F.lit(1.0).alias("value"))


def test_lifecycle_stream_equals_batch(spark, tmp_path):
    batch = {(r.event_id, r.problem) for r in L.violations(events(spark), "user_id", "event_id", "ts", "event_type", L.EVENT_PHASES).collect()}
    assert batch == {(3, "out of order"), (5, "after terminal"), (7, "time decreases"), (12, "after terminal")}
    for i in range(2):  # two files, so state crosses micro-batches
        events(spark).where("event_id <= 3" if i == 0 else "event_id > 3").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(events(spark).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = L.lifecycle_stream(stream).writeStream.format("memory").queryName("violations").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.event_id, r.problem) for r in spark.table("violations").collect()} == batch


def test_counters_and_ingestion(spark, tmp_path):
    events(spark).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events(spark).schema).parquet(f"{tmp_path}/in")
    q = L.counters(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, L.counters(events(spark)).collect()))
    q = L.ingest_changed(stream, f"{tmp_path}/out", f"{tmp_path}/cp2", ["event_id"]).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(EVENTS)
    usage = spark.createDataFrame([("m", i, 100.0, 100.0 * r) for i, r in enumerate([1, 2, 9])], "m string, i int, e double, a double")
    assert L.observed_usage(usage, "m", "i", "e", "a").first().calibration == 2.0
