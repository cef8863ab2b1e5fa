"""Sources and sinks: folders of Markdown, JSON lines, tagged index records, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import paths as P

PAGE_SCHEMA = """kind string, schemaVersion int, articleId string, path string, type string, description string, resource array<string>,
    timestamp string, tags array<string>, bodyHash string, descriptionHash string"""
CHUNK_SCHEMA = """kind string, schemaVersion int, articleId string, path string, heading string, ordinal int, bodyHash string, embedTextHash string,
    vector array<float>, vectorModel string, dimensions int, updatedAt string"""
INDEX_SCHEMA = """kind string, schemaVersion int, articleId string, path string, type string, description string, resource array<string>, timestamp string,
    tags array<string>, bodyHash string, descriptionHash string, heading string, ordinal int, embedTextHash string, vector array<float>, vectorModel string, dimensions int, updatedAt string"""
METADATA_SCHEMA = "kind string, id string, name string, wikiFolder string, sourcePaths array<string>, type string, description string, extractionCues array<string>, minMentionsForPage int, wikiSubfolder string, path string, hash string, position int"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_pages(spark: SparkSession, folder: str, relative_to: str = "") -> DataFrame:
    """(path, content) of every file below a folder, one row a file, of any size;
    files that vanish meanwhile are left out."""
    rows = spark.read.option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").text(folder, wholetext=True)
    name = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    return rows.select(F.regexp_replace(F.url_decode(F.regexp_replace(name, r"\+", "%2B")), f"^{relative_to}", "").alias("path"), F.col("value").alias("content"))


def page_rows(files: DataFrame) -> DataFrame:
    """Only pages: Markdown files that are no service files."""
    return files.where(P.is_page_path(F.col("path")))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines under a schema; blank lines are skipped, and a bad line fails
    the read (or, not strict, becomes a row with ``_corrupt_record``)."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """All index records of a domain with their raw line; empty without the file."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{INDEX_SCHEMA}, value string")
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", INDEX_SCHEMA, {"mode": "PERMISSIVE"}).alias("r"), "value").select("r.*", "value")


def is_page_record() -> Column:
    """Valid page rows: version 1 and all required fields."""
    return (F.col("kind") == "page") & (F.col("schemaVersion") == 1) & F.forall(F.array("articleId", "path", "type", "description", "bodyHash", "descriptionHash"), lambda x: x.isNotNull()) & F.col("resource").isNotNull()


def is_chunk_record() -> Column:
    """Valid chunk rows: finite vector of the stated size, ordinal from 0."""
    from lorekeep.operators.vectors import usable

    fields = F.forall(F.array("articleId", "path", "heading", "bodyHash", "embedTextHash", "vectorModel", "updatedAt"), lambda x: x.isNotNull())
    return (F.col("kind") == "chunk") & (F.col("schemaVersion") == 1) & fields & (F.col("ordinal") >= 0) & (F.size("vector") == F.col("dimensions")) & usable(F.col("vector"))


def split_index(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, chunks, others kept verbatim)."""
    page, chunk = F.coalesce(is_page_record(), F.lit(False)), F.coalesce(is_chunk_record(), F.lit(False))
    return records.where(page).drop("value"), records.where(chunk).drop("value"), records.where(~F.coalesce(F.col("kind").isin("page", "chunk"), F.lit(False))).select("kind", "value")


def invalid_index_rows(records: DataFrame) -> DataFrame:
    """Page and chunk rows that break their schema."""
    ok = F.coalesce(is_page_record() | is_chunk_record(), F.lit(False))
    return records.where(F.col("kind").isin("page", "chunk") & ~ok).select("kind", "value")


def vector_cache(chunks: DataFrame, model: str, dimensions: int) -> DataFrame:
    """Vectors of one model and size by article; the predicates reach the scan."""
    own = chunks.where((F.col("vectorModel") == model) & (F.col("dimensions") == dimensions))
    return own.groupBy("articleId").agg(F.sort_array(F.collect_list(F.struct("ordinal", "heading", "embedTextHash", "vector"))).alias("chunks"))


def fold_metadata(rows: DataFrame) -> DataFrame:
    """One nested row a domain of its ``domain``, ``entity_type`` and ``source_state`` rows (by ``id``)."""
    head = rows.where("kind = 'domain'").select("id", "name", "wikiFolder", "sourcePaths")
    types = rows.where("kind = 'entity_type'").groupBy("id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", F.struct("type", "description", "extractionCues", "minMentionsForPage", "wikiSubfolder").alias("t")))), lambda x: x["t"]).alias("entityTypes")
    )
    state = rows.where("kind = 'source_state'").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("path", "hash"))).alias("analyzedSources"))
    return head.join(types, "id", "left").join(state, "id", "left")


def unfold_metadata(domains: DataFrame) -> DataFrame:
    """The rows of nested domains, the inverse of ``fold_metadata``."""
    head = domains.select(F.lit("domain").alias("kind"), "id", "name", "wikiFolder", "sourcePaths")
    types = domains.select("id", F.posexplode("entityTypes").alias("position", "t")).select(F.lit("entity_type").alias("kind"), "id", "position", "t.*")
    state = domains.select("id", F.explode("analyzedSources").alias("path", "hash")).select(F.lit("source_state").alias("kind"), "id", "path", "hash")
    return head.unionByName(types, allowMissingColumns=True).unionByName(state, allowMissingColumns=True)


def append_log(df: DataFrame, path: str) -> None:
    """Appends rows to a log of JSON lines."""
    write_jsonl(df, path, "append")


def log_rows(events: DataFrame, domain: Column) -> DataFrame:
    """Operation events as log rows with a schema version and time."""
    return events.select(F.lit(1).alias("schemaVersion"), domain.alias("domainId"), F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), F.col("operation"), F.col("entries"))


def legacy_log_blocks(markdown: DataFrame, text: str = "content") -> DataFrame:
    """Blocks of a Markdown log between ``---`` lines, with their times."""
    blocks = markdown.select(*[c for c in markdown.columns if c != text], F.posexplode(F.split(text, r"(?m)^---\s*$")).alias("pos", "block")).where(F.col("block").rlike(r"\S"))
    return blocks.withColumn("timestamp", F.nullif(F.regexp_extract("block", r"(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?)", 1), F.lit("")))


def last_by_run(records: DataFrame, order: str, run: str = "runId") -> DataFrame:
    from lorekeep.operators.maintenance import last_by

    return last_by(records, [run], order)


def toggle_rating(records: DataFrame, run_id: str, axis: str, rating: str, order: str) -> DataFrame:
    """Sets a rating of the last record of a run, or clears it if it is set already."""
    last = records.where(F.col("runId") == run_id).agg(F.max(order)).scalar()
    hit = (F.col("runId") == run_id) & (F.col(order) == last)
    cleared = F.map_filter("ratings", lambda k, v: k != axis)
    fresh = F.when(F.col("ratings")[axis] == rating, cleared).otherwise(F.map_concat(cleared, F.create_map(F.lit(axis), F.lit(rating))))
    return records.withColumn("ratings", F.when(F.coalesce(hit, F.lit(False)), fresh).otherwise(F.col("ratings")))


def set_comment(records: DataFrame, run_id: str, comment: str, order: str) -> DataFrame:
    last = records.where(F.col("runId") == run_id).agg(F.max(order)).scalar()
    return records.withColumn("comment", F.when((F.col("runId") == run_id) & (F.col(order) == last), F.lit(comment)).otherwise(F.col("comment")))


def stream_events(lines: DataFrame, schema: str) -> DataFrame:
    """Typed events of a stream of output lines; lines that are no JSON objects are left out."""
    return lines.where(F.col("value").startswith("{")).select(F.from_json("value", schema).alias("e")).where("e is not null").select("e.*")


def replace_partition(df: DataFrame, path: str, key: str) -> None:
    """Rewrites only the partitions of ``key`` that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def call_service(rows: DataFrame, schema: str, scorer, batch: int = 100) -> DataFrame:
    """The connector of embedding and reranking services: ``scorer`` maps lists of
    at most ``batch`` rows (dicts) to rows, on the executors."""
    import pandas as pd

    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(frames):
        for pdf in frames:
            rows_ = pdf.to_dict("records")
            out = [r for i in range(0, len(rows_), batch) for r in scorer(rows_[i : i + batch])]
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, schema)
