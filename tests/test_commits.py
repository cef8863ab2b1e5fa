import threading

import pytest
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from lorekeep.operators import vectors
from lorekeep.sources.commits import CommittedTable, Conflict, Rejected

SCHEMA = StructType().add("id", LongType()).add("grp", StringType()).add("pos", LongType()).add("text", StringType())


@pytest.fixture
def table(spark, tmp_path):
    return CommittedTable(spark, f"file://{tmp_path}/table", SCHEMA, ["id", "grp"], "pos")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_and_rollback(spark, table):
    assert table.version() == 0 and rows(table.read()) == []
    assert table.commit(frame(spark, [(1, "a", 1, "x"), (1, "a", 3, "last"), (1, "a", 2, "y"), (2, "a", 1, "z")])) == 1
    assert table.commit(frame(spark, [(2, "a", 0, "newer"), (3, "b", 1, None)]), deleted=frame(spark, [(1, "a", 0, "")])) == 2
    assert rows(table.read()) == [(2, "a", 0, "newer"), (3, "b", 1, None)]
    assert rows(table.read(1)) == [(1, "a", 3, "last"), (2, "a", 1, "z")]
    assert table.commit(frame(spark, [(1, "a", 9, "back")])) == 3
    assert rows(table.read()) == [(1, "a", 9, "back"), (2, "a", 0, "newer"), (3, "b", 1, None)]
    kept = rows(table.read())
    assert table.compact() == 4 and rows(table.read()) == kept and len(table.manifest()["parts"]) == 1
    assert table.rollback(1) == 5 and rows(table.read()) == rows(table.read(1))
    assert table.commit(frame(spark, [(2, "a", 0, "after")])) == 6
    assert rows(table.read()) == [(1, "a", 3, "last"), (2, "a", 0, "after")]


def test_the_second_of_two_writers_changes_nothing(spark, table):
    table.commit(frame(spark, [(1, "a", 1, "x")]))
    seen = table.version()
    table.commit(frame(spark, [(1, "a", 2, "first")]), expected=seen)
    parts = lambda: spark.read.parquet(f"{table.path}/parts/*").count()
    n = parts()
    with pytest.raises(Conflict):
        table.commit(frame(spark, [(1, "a", 3, "second")]), expected=seen)
    assert parts() == n and rows(table.read()) == [(1, "a", 2, "first")] and table.versions() == [1, 2]


def test_two_threads_lose_nothing(spark, table):
    def work(name):
        for i in range(3):
            while True:
                try:
                    table.commit(frame(spark, [(i, name, 1, name)]))
                    break
                except Conflict:
                    pass

    threads = [threading.Thread(target=work, args=(n,)) for n in ("p", "q")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert rows(table.read()) == sorted((i, n, 1, n) for n in ("p", "q") for i in range(3)) and table.versions() == list(range(1, 7))


def test_rows_that_have_changed_since_they_were_read(spark, table):
    table.commit(frame(spark, [(1, "a", 1, "x"), (2, "a", 1, None)]))
    before = frame(spark, rows(table.read()))
    table.commit(frame(spark, [(2, "a", 2, "other")]))
    with pytest.raises(Conflict, match="changed"):
        table.commit(frame(spark, [(2, "a", 3, "mine")]), before=before)
    with pytest.raises(Conflict, match="changed"):  # there now, and was not when it was read
        table.commit(frame(spark, [(2, "a", 3, "mine")]), before=before.where("id < 0"))
    table.commit(frame(spark, [(1, "a", 3, "mine"), (7, "n", 1, "new")]), before=before)
    assert rows(table.read()) == [(1, "a", 3, "mine"), (2, "a", 2, "other"), (7, "n", 1, "new")]


def test_stale_vectors_stop_a_commit(spark, tmp_path):
    schema = StructType().add("article_id", StringType()).add("ordinal", IntegerType()).add("hash", StringType())
    table = CommittedTable(spark, f"file://{tmp_path}/chunks", schema, ["article_id", "ordinal"])
    index = spark.createDataFrame([("p", "h1", "m", 2, [1.0, 0.0]), ("q", "h2", "m", 2, [float("nan"), 0.0])], "article_id string, hash string, model string, dimensions int, vector array<double>")
    check = lambda staged: vectors.stale_vectors(staged, index, "m", 2)
    table.commit(spark.createDataFrame([("p", 0, "h1")], schema), check=check)
    with pytest.raises(Rejected, match="1 rows"):
        table.commit(spark.createDataFrame([("p", 1, "h1"), ("q", 0, "h2")], schema), check=check)
    assert table.version() == 1 and rows(table.read()) == [("p", 0, "h1")]


def test_a_repeated_batch_is_committed_once(spark, table):
    batch = frame(spark, [(1, "a", 1, "x")])
    assert table.commit(batch, stream=("s", 4)) == 1
    table.commit(frame(spark, [(1, "a", 0, "later")]))
    assert table.commit(batch, stream=("s", 4)) == 2 and table.commit(batch, stream=("s", 3)) == 2
    assert rows(table.read()) == [(1, "a", 0, "later")]
    assert table.commit(batch, stream=("other", 4)) == 3


def test_a_stream_is_committed_exactly_once(spark, table, tmp_path):
    for k in range(3):
        frame(spark, [(i, "s", k, f"v{k}") for i in range(k, 4)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    table.sink(stream, "s", f"{tmp_path}/one").trigger(availableNow=True).start().awaitTermination()
    want = {i: max(k for k in range(3) if k <= i) for i in range(4)}
    assert {r.id: r.pos for r in table.read().collect()} == want
    n = table.version()
    assert n == 3
    # The same input from the start, as after the loss of the checkpoint: all of it is known.
    table.sink(stream, "s", f"{tmp_path}/two").trigger(availableNow=True).start().awaitTermination()
    assert table.version() == n and {r.id: r.pos for r in table.read().collect()} == want
