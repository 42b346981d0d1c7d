"""Workspace discovery, framework probes, objective and trace readers, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..operators import enrich

#: Project files by name, and the words that give a framework away.
META_FILES = {"pyproject.toml": "python", "requirements.txt": "python", "setup.py": "python", "package.json": "typescript", "go.mod": "go", "Cargo.toml": "rust"}
FRAMEWORKS = {"fastapi": "fastapi", "flask": "flask", "django": "django", "express": "express", "fastify": "fastify", "@nestjs": "nestjs", "gin-gonic": "gin", "labstack/echo": "echo", "axum": "axum", "actix-web": "actix", "sqlalchemy": "sqlalchemy", "gorm.io": "gorm", "sqlx": "sqlx", "redis": "redis", "grpc": "grpc"}


def discover(spark: SparkSession, folder: str, keep_tests: bool = False) -> DataFrame:
    """(file_id, path, language, content) of the sources below a folder, numbered by path.

    Tool and cache folders are dropped, and tests unless asked for; of other files, only those of the four languages stay.
    """
    raw = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("full"))
    return from_rows(raw.select(F.regexp_replace("full", "^file:/+", "/").alias("path"), F.col("value").alias("content")), folder, keep_tests)


def from_rows(rows: DataFrame, root: str = "", keep_tests: bool = False) -> DataFrame:
    """The same from (path, content); ids are made in two steps, ranks within folders and sums of folders, so no task sees all files."""
    cut = F.when(F.col("path").startswith(root.rstrip("/") + "/"), F.substring("path", len(root.rstrip("/")) + 2, 1 << 20)).otherwise(F.col("path")) if root else F.col("path")
    d = rows.select(cut.alias("path"), "content").withColumn("language", C.language_of(F.col("path"))).filter(F.col("language").isNotNull() & ~C.excluded(F.col("path")))
    if not keep_tests:
        d = d.filter(~C.is_test_file(F.col("path"), F.col("language")))
    d = d.withColumn("dir", F.regexp_replace("path", "[^/]*$", ""))
    sizes = d.groupBy("dir").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("dir").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = d.withColumn("r", F.row_number().over(Window.partitionBy("dir").orderBy("path")))
    return ranked.join(before, "dir").select((F.col("before") + F.col("r") - 1).alias("file_id"), "path", "language", "content")


def frameworks(files: DataFrame) -> DataFrame:
    """(framework, files): how many files name each framework."""
    probes = F.array(*[F.when(F.col("content").contains(k), F.lit(v)) for k, v in FRAMEWORKS.items()])
    return files.select("path", F.explode(F.array_distinct(F.filter(probes, lambda x: x.isNotNull()))).alias("framework")).groupBy("framework").agg(F.count("*").alias("files"))


def meta_files(paths: DataFrame) -> DataFrame:
    """(path, ecosystem) of project files."""
    name = F.substring_index("path", "/", -1)
    return paths.select("path", C.first_of([(name == n, e) for n, e in META_FILES.items()]).alias("ecosystem")).filter("ecosystem is not null")


def changed_only(files: DataFrame, changed: list[str]) -> DataFrame:
    """The named files; names are those of one commit."""
    return files.filter(F.col("path").isin(list(dict.fromkeys(changed))))


def new_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose (path, content hash) isn't stored yet."""
    return files.withColumn("content_hash", F.xxhash64("content")).join(stored.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def read_slos(spark: SparkSession, tagged: str | None = None, described: str | None = None) -> DataFrame:
    """Objectives of JSON exports: one kind keeps path and method in tags, the other in its name or description."""
    parts = []
    if tagged:
        parts.append(enrich.slo_from_tags(spark.read.schema("id string, name string, tags array<string>").json(tagged)))
    if described:
        parts.append(enrich.slo_from_text(spark.read.schema("id string, name string, description string").json(described)))
    out = spark.createDataFrame([], "slo_id string, name string, path_pattern string, http_method string")
    for p in parts:
        out = out.unionByName(p)
    return out


TRACE_SCHEMA = "traceId string, spans array<struct<spanId:string,parentSpanId:string,kind:string,name:string,startTime:timestamp,endTime:timestamp,labels:map<string,string>>>"


def spans_of(traces: DataFrame, since: Column | None = None) -> DataFrame:
    """Spans of (traceId, spans) rows as (trace_id, span_id, parent_span_id, kind, name, start_time, latency_ms, service, labels)."""
    s = traces.select("traceId", F.explode("spans").alias("s")).select(F.col("traceId").alias("trace_id"), "s.*")
    out = s.select("trace_id", F.col("spanId").alias("span_id"), F.col("parentSpanId").alias("parent_span_id"), "kind", "name", F.col("startTime").alias("start_time"), enrich.latency_ms(F.col("startTime"), F.col("endTime")).alias("latency_ms"), enrich.service_of(F.col("labels"), F.col("name")).alias("service"), "labels")
    return out.filter(F.col("start_time") >= since) if since is not None else out


def read_traces(spark: SparkSession, path: str, since: Column | None = None) -> DataFrame:
    return spans_of(spark.read.schema(TRACE_SCHEMA).json(path), since)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def sarif(findings: DataFrame) -> DataFrame:
    """One SARIF result per finding, as JSON text in ``value``."""
    level = F.when(F.col("severity").isin("Critical", "High"), "error").when(F.col("severity") == "Medium", "warning").otherwise("note")
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    return findings.select(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.array(place).alias("locations"))).alias("value"))
