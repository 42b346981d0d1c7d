"""Observability coverage: which calls under a route are seen by traces, logs and metrics, and which are not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..plans.traverse import bfs


def sites_with_roles(sites: DataFrame) -> DataFrame:
    """Call sites with role (db, http_client or logic) and the statement kind of database calls.

    Callees repeat, so each distinct text is classified once and joined back.
    """
    name, verb = F.col("name"), F.col("verb")
    d = sites.select("callee").distinct().withColumn("name", F.lower(C.callee_name(F.col("callee"))))
    d = d.withColumn("verb", C.verb_of(name)).withColumn("receiver", C.receiver_of(name))
    d = d.withColumn("role", F.when(C.is_db_call(name, verb, F.col("receiver")), "db").when(C.is_http_call(name, verb, F.col("receiver")), "http_client").otherwise("logic"))
    known = d.select("callee", "role", F.when(F.col("role") == "db", C.statement_kind(name, verb)).alias("statement"))
    return sites.join(known, "callee")


def instrumented(sites: DataFrame, uses: DataFrame, libs: DataFrame) -> DataFrame:
    """(file_id): files that make a span themselves, or use an observability library."""
    own = sites.filter(C.signal_kind(F.col("callee")) == "trace").select("file_id")
    lib = uses.join(libs.filter("category = 'Observability'").select("lib_id"), "lib_id", "left_semi").select(F.col("src").alias("file_id"))
    return own.unionByName(lib).distinct()


def boundaries(functions: DataFrame, calls: DataFrame, sites: DataFrame, depth: int | None = None, stop: DataFrame | None = None) -> DataFrame:
    """(anchor, fn_id, depth, file_id, line, callee, role, statement): boundary calls under each handler, by one traversal.

    The walk ends at functions in ``stop`` (node), those that are a library's boundary themselves, and after ``depth`` calls if given.
    """
    h = functions.filter("is_handler").select(F.col("fn_id").alias("anchor"), F.col("fn_id").alias("node"))
    walk = bfs(h, calls, depth, stop=stop).select("anchor", F.col("node").alias("fn_id"), "depth")
    edge = sites_with_roles(sites).filter("role <> 'logic'").select("fn_id", "file_id", "line", "callee", "role", "statement")
    return walk.join(edge, "fn_id")


def coverage_summary(bounds: DataFrame, seen: DataFrame) -> DataFrame:
    """(role, boundaries, observed) over distinct boundary calls."""
    b = bounds.select("file_id", "line", "callee", "role").distinct().join(seen.select("file_id", F.lit(1).alias("seen")), "file_id", "left")
    return b.groupBy("role").agg(F.count("*").alias("boundaries"), F.count("seen").alias("observed"))


def unobserved(bounds: DataFrame, seen: DataFrame, role: str | None = None) -> DataFrame:
    """(callee, file_id, line, role, routes): boundary calls that nothing sees, by the number of routes that reach them."""
    b = bounds.join(seen, "file_id", "left_anti")
    b = b.filter(F.col("role") == role) if role else b
    return b.groupBy("callee", "file_id", "line", "role").agg(F.countDistinct("anchor").alias("routes"))


def critical_unobserved(bounds: DataFrame, seen: DataFrame, role: str | None, limit: int) -> DataFrame:
    return unobserved(bounds, seen, role).orderBy(F.desc("routes"), "callee", "file_id", "line").limit(limit)


def logging_quality(files: DataFrame, imports: DataFrame, uses: DataFrame, libs: DataFrame) -> DataFrame:
    """(file_id, path, quality): a logging library of its own, of a file it imports, or none."""
    direct = uses.join(libs.filter("category = 'Logging'").select("lib_id"), "lib_id", "left_semi").select(F.col("src").alias("file_id")).distinct()
    near = imports.join(direct.select(F.col("file_id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("file_id")).distinct()
    d = files.join(direct.withColumn("d", F.lit(1)), "file_id", "left").join(near.withColumn("n", F.lit(1)), "file_id", "left")
    return d.select("file_id", "path", F.when(F.col("d") == 1, "direct").when(F.col("n") == 1, "via_import").otherwise("none").alias("quality"))


def logging_clusters(quality: DataFrame, least: int = 5) -> DataFrame:
    """(dir, files, direct, via_import, none) of folders with at least ``least`` files."""
    d = quality.withColumn("dir", F.regexp_replace("path", "/[^/]*$", ""))
    out = d.groupBy("dir").agg(F.count("*").alias("files"), *[F.count_if(F.col("quality") == q).alias(q) for q in ("direct", "via_import", "none")])
    return out.filter(F.col("files") >= least)


def metrics_clusters(files: DataFrame, uses: DataFrame, libs: DataFrame, least: int = 5) -> DataFrame:
    """(dir, files, present): how many of a folder's files use an observability library."""
    has = uses.join(libs.filter("category = 'Observability'").select("lib_id"), "lib_id", "left_semi").select(F.col("src").alias("file_id")).distinct().withColumn("has", F.lit(1))
    d = files.join(has, "file_id", "left").withColumn("dir", F.regexp_replace("path", "/[^/]*$", ""))
    return d.groupBy("dir").agg(F.count("*").alias("files"), F.count("has").alias("present")).filter(F.col("files") >= least)


def auto_instruments(sites: DataFrame) -> DataFrame:
    """(file_id, framework): what a file instruments as a whole; of several, the smallest name."""
    return sites.withColumn("framework", C.instrumentor(F.col("callee"))).filter("framework is not null").groupBy("file_id").agg(F.min("framework").alias("framework"))


def statement_mix(sites: DataFrame) -> DataFrame:
    return sites_with_roles(sites).filter("role = 'db'").groupBy("statement").agg(F.count("*").alias("n"), F.count_if("in_loop").alias("in_loop"))


def potential_n_plus_one(sites: DataFrame) -> DataFrame:
    """(file_id, line, callee): select-like database calls in loops."""
    return sites_with_roles(sites).filter("statement = 'select' and in_loop").select("file_id", "line", "callee")
