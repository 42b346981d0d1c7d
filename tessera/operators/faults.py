"""Where a fault shows and what it reaches: routes above a function, upstream services below it, and fault templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.traverse import bfs

#: The templates and their flags; {direction} is filled in by the caller.
TEMPLATES = (
    ("latency-normal", ("--with-latency", "--latency-direction {direction}", "--latency-distribution normal", "--latency-mean 350", "--latency-stddev 50")),
    ("latency-pareto", ("--with-latency", "--latency-direction {direction}", "--latency-distribution pareto", "--latency-shape 1.5", "--latency-scale 20")),
    ("latency-window", ("--with-latency", "--latency-direction {direction}", "--latency-distribution normal", "--latency-mean 500", "--latency-stddev 100", '--latency-sched "start:25%,duration:50%"')),
    ("jitter-light", ("--with-jitter", "--jitter-amplitude 30", "--jitter-frequency 5")),
    ("jitter-bidirectional", ("--with-jitter", "--jitter-amplitude 30", "--jitter-frequency 8", "--jitter-direction both")),
    ("bandwidth-64k", ("--with-bandwidth", "--bandwidth-rate 64", "--bandwidth-unit KBps", "--bandwidth-direction ingress")),
    ("bandwidth-48k-latency", ("--with-bandwidth", "--bandwidth-rate 48", "--bandwidth-unit KBps", "--with-latency", "--latency-direction both", "--latency-distribution normal", "--latency-mean 200", "--latency-stddev 20")),
    ("mobile-3g", ("--with-bandwidth", "--bandwidth-rate 48", "--bandwidth-unit KBps", "--with-latency", "--latency-direction both", "--latency-distribution normal", "--latency-mean 200", "--latency-stddev 20", "--with-jitter", "--jitter-amplitude 30", "--jitter-frequency 5")),
    ("packet-loss", ("--with-packet-loss", "--packet-loss-direction {direction}")),
    ("packet-loss-burst", ("--with-packet-loss", "--packet-loss-direction {direction}", '--packet-loss-sched "start:25%,duration:50%"')),
    ("blackhole", ("--with-blackhole", "--blackhole-direction {direction}")),
    ("blackhole-window", ("--with-blackhole", "--blackhole-direction {direction}", '--blackhole-sched "start:25%,duration:50%"')),
)


def fault_routes(calls: DataFrame, functions: DataFrame, seeds: DataFrame, depth: int = 10) -> DataFrame:
    """(anchor, http_method, http_path): routes of a function itself and of the handlers that call it within ``depth``."""
    walk = bfs(seeds.select(F.col("fn_id").alias("anchor"), F.col("fn_id").alias("node")), calls, depth, reverse=True)
    h = functions.filter("is_handler").select(F.col("fn_id").alias("node"), "http_method", "http_path")
    return walk.join(h, "node").select("anchor", "http_method", "http_path").distinct()


def egress_targets(calls: DataFrame, functions: DataFrame, uses: DataFrame, libs: DataFrame, seeds: DataFrame, depth: int = 10, categories=("HttpClient", "Database")) -> DataFrame:
    """(anchor, category, upstream): libraries that reach out, of the files of all functions below an anchor, each once."""
    walk = bfs(seeds.select(F.col("fn_id").alias("anchor"), F.col("fn_id").alias("node")), calls, depth)
    files = walk.join(functions.select(F.col("fn_id").alias("node"), "file_id"), "node").select("anchor", "file_id").distinct()
    out = uses.join(libs.filter(F.col("category").isin(*categories)), "lib_id").select(F.col("src").alias("file_id"), "category", F.col("name").alias("upstream"))
    return files.join(out, "file_id").select("anchor", "category", "upstream").distinct()


def templates(spark: SparkSession, direction: str = "ingress") -> DataFrame:
    """(template, flags)."""
    rows = [(name, [f.replace("{direction}", direction) for f in flags]) for name, flags in TEMPLATES]
    return spark.createDataFrame(rows, "template string, flags array<string>")
