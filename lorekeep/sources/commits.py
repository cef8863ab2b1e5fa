"""Tables that change by commits: staged files, a manifest a version, compare-and-swap.

A table is a folder. ``parts`` holds what was staged, ``versions`` one small file a version that
lists the parts it consists of. What is staged is invisible until a version lists it, and a
version is made by creating its file, which fails where the file is there already: of two
writers that started from one version the second gets a ``Conflict`` and has changed nothing.
(Creation that fails on an existing file must be exclusive, as it is in HDFS.)

A commit writes changed rows only. A part holds rows and marks of deleted keys; a reader takes the
last row of each key, by the version that brought it, then by the table's order column. ``compact``
rewrites a version's rows as one part. Rolling back makes a new version of an old one's parts.

Commits of a stream carry its name and epoch; an epoch that a version already holds is left
out, so a micro-batch that is delivered again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another commit came first, or rows are not what the writer had read."""


class Rejected(Exception):
    """A check found rows that must not be committed."""


_GONE, _VERSION, _PLACE = "__gone", "__version", "__place"


class CommittedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], order: str | None = None):
        self.spark, self.path, self.schema, self.keys, self.order = spark, path.rstrip("/"), schema, keys, order

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _create(self, path: str, text: str) -> None:
        fs, p = self._files(path)
        try:
            out = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                raise Conflict(f"{path} exists") from e
            raise
        out.write(bytearray(text.encode()))
        out.close()

    def versions(self) -> list[int]:
        fs, p = self._files(f"{self.path}/versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []

    def version(self) -> int:
        """The last version, 0 of a table without any."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "parts": [], "epochs": {}}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{version}", wholetext=True).first()[0])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the last one): the last row of each key that is not deleted."""
        parts = self.manifest(version)["parts"]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        stored = StructType([*self.schema.fields, *self.spark.range(0).select(F.lit(True).alias(_GONE)).schema.fields])
        rows = reduce(DataFrame.unionByName, (self.spark.read.schema(stored).parquet(f"{self.path}/parts/{p['part']}").withColumn(_VERSION, F.lit(p["version"])) for p in parts))
        names = self.schema.names
        last = F.struct(_VERSION, *([self.order] if self.order else []), F.struct(*[F.col(n) for n in names if n not in self.keys and n != self.order]).cast("string").alias(_PLACE))
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*[n for n in names if n not in self.keys], _GONE), last).alias("__row"))
        return best.where(f"not __row.{_GONE}").select(*[n if n in self.keys else F.col(f"__row.{n}").alias(n) for n in names])

    def stage(self, rows: DataFrame | None = None, deleted: DataFrame | None = None) -> str:
        """Writes rows, and marks of deleted keys, where no version lists them yet."""
        made = []
        if rows is not None:
            made.append(rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields], F.lit(False).alias(_GONE)))
        if deleted is not None:
            kept = {f.name: F.col(f.name) if f.name in self.keys else F.lit(None) for f in self.schema.fields}
            made.append(deleted.select(*[kept[f.name].cast(f.dataType).alias(f.name) for f in self.schema.fields], F.lit(True).alias(_GONE)))
        name = uuid.uuid4().hex
        reduce(DataFrame.unionByName, made).write.parquet(f"{self.path}/parts/{name}")
        return name

    def _publish(self, base: dict, parts: list[dict], epochs: dict) -> int:
        version = base["version"] + 1
        self._create(f"{self.path}/versions/{version}", json.dumps({"version": version, "parts": parts, "epochs": epochs}))
        return version

    def discard(self, part: str) -> None:
        """Deletes what was staged and not committed."""
        if any(part == p["part"] for v in self.versions() for p in self.manifest(v)["parts"]):
            raise ValueError("a version lists this part")
        fs, p = self._files(f"{self.path}/parts/{part}")
        fs.delete(p, True)

    def commit(
        self,
        rows: DataFrame | None = None,
        deleted: DataFrame | None = None,
        expected: int | None = None,
        before: DataFrame | None = None,
        check: Callable[[DataFrame], DataFrame] | None = None,
        stream: tuple[str, int] | None = None,
    ) -> int:
        """Commits changed ``rows`` and ``deleted`` keys on top of the version ``expected`` (the last),
        and returns the new version.

        ``before`` holds the rows that the writer has read of the keys it changes: a key whose row
        differs now, or is there now and was not, is a ``Conflict``. ``check`` gets the staged rows and
        returns those that must not be committed. Where anything fails, what was staged is deleted."""
        base = self.manifest(expected)
        if stream and base["epochs"].get(stream[0], -1) >= stream[1]:
            return base["version"]
        part = self.stage(rows, deleted)
        try:
            staged = self.spark.read.parquet(f"{self.path}/parts/{part}")
            if check is not None:
                bad = check(staged.where(f"not {_GONE}").drop(_GONE))
                if not bad.isEmpty():
                    raise Rejected(f"{bad.count()} rows must not be committed")
            if before is not None and not self._changed(staged, before, base["version"]).isEmpty():
                raise Conflict("rows have changed since they were read")
            epochs = base["epochs"] | ({stream[0]: stream[1]} if stream else {})
            return self._publish(base, [*base["parts"], {"part": part, "version": base["version"] + 1}], epochs)
        except BaseException:
            self.discard(part)
            raise

    def _changed(self, staged: DataFrame, before: DataFrame, version: int) -> DataFrame:
        """Keys of the write set whose rows now are not those of ``before``."""
        whole = lambda df, name: df.select(*self.keys, F.struct(*self.schema.names).alias(name))
        keys = staged.select(*self.keys).distinct()
        same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in self.keys])
        now, then = whole(self.read(version), "now"), whole(before, "then")
        met = keys.join(now, same(keys, now), "left").select(*[keys[k] for k in self.keys], "now")
        return met.join(then, same(met, then), "left").where(~F.col("now").eqNullSafe(F.col("then")))

    def rollback(self, version: int) -> int:
        """A new version with the rows of an old one. Epochs stay, so no batch comes twice."""
        old, base = self.manifest(version), self.manifest()
        rows = [p | {"version": p["version"]} for p in old["parts"]]
        return self._publish(base, rows, base["epochs"])

    def compact(self) -> int:
        """A new version whose rows are one part."""
        base = self.manifest()
        part = self.stage(self.read(base["version"]))
        try:
            return self._publish(base, [{"part": part, "version": base["version"] + 1}], base["epochs"])
        except BaseException:
            self.discard(part)
            raise

    def sink(self, stream: DataFrame, name: str, checkpoint: str):
        """A writer that commits each micro-batch of ``stream`` exactly once, also where another
        writer commits between."""

        def write(batch: DataFrame, epoch: int) -> None:
            for _ in range(100):
                try:
                    self.commit(batch, stream=(name, epoch))
                    return
                except Conflict:
                    continue
            raise Conflict("other writers came first a hundred times")

        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
