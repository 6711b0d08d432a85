"""The catalogue of runs and benchmarks: ingestion, identity, tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import errors

RUNS = (
    "run_id string, dataset_hash string, config string, emit_index_at_end long, pacing_slip_nanos long, "
    "canonical_hash string, error string, started_unix_nano long, ended_unix_nano long, elapsed_nanos long"
)
BENCHMARKS = (
    "name string, git_commit string, recorded_unix_nano long, sample int, iterations long, ns_per_op double, "
    "bytes_per_op long, allocs_per_op long"
)
MANIFEST = (
    "dataset array<struct<path: string, hash: string>>, "
    "result struct<emit_index_at_end: bigint, pacing_slip_nanos: bigint, canonical_hash: string, error: string>, "
    "timing struct<started_unix_nano: bigint, ended_unix_nano: bigint, elapsed_nanos: bigint>"
)


def create_tables(spark: SparkSession, runs: str = "runs", benchmarks: str = "benchmarks") -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {runs} ({RUNS}) USING parquet")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {benchmarks} ({BENCHMARKS}) USING parquet")


def dataset_hash(files: Column) -> Column:
    """SHA-256 of the lines path, tab, hash of an array of files, in its order."""
    lines = F.transform(files, lambda f: F.concat(f["path"], F.lit("\t"), f["hash"], F.lit("\n")))
    return F.sha2(F.array_join(lines, ""), 256)


def parse_manifests(texts: DataFrame) -> DataFrame:
    """Rows of the table of runs, of (run_id, value) with the text of a manifest."""
    m = F.from_json("value", MANIFEST)
    return texts.withColumn("m", m).select(
        "run_id", dataset_hash(F.col("m.dataset")).alias("dataset_hash"),
        F.get_json_object("value", "$.config").alias("config"), "m.result.*", "m.timing.*",
    )


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Manifests ``*.json`` of a folder; a run is named by its file."""
    texts = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    run = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return parse_manifests(texts.select(run.alias("run_id"), "value"))


def append(rows: DataFrame, table: str, key: list[str], kind: str) -> int:
    """Append all rows or none: a key that repeats, or that the table has, is an error."""
    spark = rows.sparkSession
    rows = rows.select(*spark.table(table).columns)
    twice = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    known = rows.join(spark.table(table).select(*key), key, "left_semi").select(*key)
    if bad := twice.unionByName(known).limit(1).collect():
        raise errors.named(kind)(str(tuple(bad[0])))
    n = rows.count()
    rows.coalesce(1).write.insertInto(table)
    return n


def ingest_manifests(spark: SparkSession, folder: str, table: str = "runs") -> int:
    return append(read_manifests(spark, folder), table, ["run_id"], "DuplicateRun")


_NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"


def parse_benchmarks(lines: DataFrame) -> DataFrame:
    """(line, name, iterations, ns_per_op, bytes_per_op, allocs_per_op, sample, fault) of (line, value).

    Lines that are no measurements are left out. The processor suffix of a name is
    dropped; samples of a name count from 0. ``fault`` names what is wrong, if any.
    """
    parts = lines.withColumn("w", F.split(F.trim("value"), r"\s+")).where(
        F.get("w", F.lit(0)).startswith("Benchmark") & (F.size("w") >= 3) & F.get("w", F.lit(1)).rlike(r"^\d+$")
    )

    def metric(unit: str) -> Column:
        at = F.array_position("w", unit).cast("int")
        return F.when(at > 1, F.get("w", at - 2))

    ns, size, allocs = metric("ns/op"), metric("B/op"), metric("allocs/op")
    fault = F.when(ns.isNull() | size.isNull() | allocs.isNull(), "MissingMetric").when(
        ~ns.rlike(_NUMBER) | ~size.rlike(r"^\d+$") | ~allocs.rlike(r"^\d+$"), "BadValue"
    )
    name = F.regexp_replace(F.get("w", F.lit(0)), r"-\d+$", "")
    order = Window.partitionBy("name").orderBy("line")
    return parts.select(
        "line", name.alias("name"), F.get("w", F.lit(1)).try_cast("long").alias("iterations"),
        ns.try_cast("double").alias("ns_per_op"), size.try_cast("long").alias("bytes_per_op"),
        allocs.try_cast("long").alias("allocs_per_op"), fault.alias("fault"),
    ).withColumn("sample", F.row_number().over(order) - 1)


def ingest_benchmarks(spark: SparkSession, path: str, git_commit: str, table: str = "benchmarks") -> int:
    """All measurements of a benchmark text, recorded at the file's time."""
    text = spark.read.text(path, wholetext=True).select("value", "_metadata.file_modification_time")
    nanos = F.unix_micros("file_modification_time") * 1000
    lines = text.select(nanos.alias("recorded"), F.posexplode(F.split("value", "\n")).alias("at", "value"))
    parsed = parse_benchmarks(lines.select((F.col("at") + 1).alias("line"), "value"))
    if bad := parsed.where("fault IS NOT NULL").orderBy("line").limit(1).collect():
        raise errors.LineError(bad[0]["line"], bad[0]["fault"])
    when = text.select(nanos).first()[0]
    rows = parsed.withColumns({"git_commit": F.lit(git_commit), "recorded_unix_nano": F.lit(when).cast("long")})
    return append(rows, table, ["name", "git_commit", "recorded_unix_nano", "sample"], "DuplicateBenchmark")


def dataset_identity(spark: SparkSession, folder: str, pattern: str = "*.bin") -> DataFrame:
    """(path, hash) of the artifacts of a folder, by path; the hash is empty where its sidecar is missing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    side = spark.read.option("pathGlobFilter", pattern + ".hash").text(folder, wholetext=True)
    own = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.hash$", 1)
    side = side.select(own.alias("name"), F.trim(F.regexp_replace("value", r"\s+$", "")).alias("hash"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).join(side, "name", "left").select("path", F.coalesce("hash", F.lit("")).alias("hash")).orderBy("path")


def artifact_hashes(spark: SparkSession, folder: str, pattern: str = "*.bin") -> DataFrame:
    """(path, hash): SHA-256 of each whole file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.sha2("content", 256).alias("hash"))


def manifest_json(manifest: dict) -> str:
    return json.dumps(manifest, indent=2) + "\n"
