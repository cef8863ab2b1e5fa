import datetime
import random

from lorekeep.streaming import lifecycle as L

SCHEMA = "user_id long, event_id long, ts timestamp, event_type string"
START = datetime.datetime(2024, 1, 1)


def made(rng):
    """Lifecycles with events of lower phases, after the end, of falling times and of unknown kinds."""
    kinds = ["signup", "view", "click", "view", "click", "purchase", "other"]
    return [(u, 100 * u + n, START + datetime.timedelta(minutes=5 * n - (4 if rng.random() < 0.3 else 0) * 2, seconds=u), rng.choice(kinds)) for u in range(9) for n in range(rng.randrange(1, 9))]


def test_any_order_within_the_watermark(spark, tmp_path):
    rng = random.Random(12)
    events = made(rng)
    end = [(99, 1, START + datetime.timedelta(days=2), "view"), (99, 2, START + datetime.timedelta(days=3), "view")]
    want = {(r.user_id, r.event_id, r.problem) for r in L.violations(spark.createDataFrame(events, SCHEMA), "user_id", "event_id", "ts", "event_type", L.EVENT_PHASES).collect()}
    assert {p for _, _, p in want} == {"out of order", "after terminal", "time decreases"}
    rng.shuffle(events)
    third = len(events) // 3
    for k, part in enumerate([events[:third], events[third : 2 * third], events[2 * third :], end[:1], end[1:]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(spark.createDataFrame(end, SCHEMA).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = L.ordered_lifecycle_stream(stream, delay="2 hours", slack_ms=3_600_000, forget_ms=3_600_000)
    out.writeStream.format("memory").queryName("ordered_violations").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(300)
    got = [(r.user_id, r.event_id, r.problem) for r in spark.table("ordered_violations").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_the_last_row_of_a_key_by_its_order(spark, tmp_path):
    rows = [("a", 1, "old"), ("a", 3, "new"), ("a", 2, "mid"), ("b", 1, None)]
    spark.createDataFrame(rows, "k string, n int, v string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, n int, v string").parquet(f"{tmp_path}/in")
    L.ingest_changed(stream, f"{tmp_path}/out", f"{tmp_path}/cp", ["k"], "n").trigger(availableNow=True).start().awaitTermination(120)
    assert {(r.k, r.n, r.v) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("a", 3, "new"), ("b", 1, None)}
