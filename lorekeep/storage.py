"""Shared scratch storage and table loading.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``; a private folder is made only for local masters that
name none (tests, notebooks).
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task sorts or hashes where ``dealt`` hands them out.
TASK_ROWS = 500_000
_own: dict[str, str] = {}
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Reads one of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates; set here only where unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _own:
        path = tempfile.mkdtemp(prefix="lorekeep-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own[sc.applicationId] = f"file://{path}"
    return _own[sc.applicationId]


def spread(df: DataFrame) -> DataFrame:
    """Deals ``df`` over all cores where its files give fewer splits than these. For work
    that is heavy for its bytes, as on texts; larger tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deals ``df``, of about ``rows`` rows, by its keys into partitions of some ``TASK_ROWS``. Spark merges
    those of its own joins by their compressed size, in which many millions of narrow rows fit."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return df.repartition(n, *keys)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{scratch_dir(spark)}/lorekeep/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage,
    survives lost executors and keeps an expensive scan from running twice."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is not installed."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
