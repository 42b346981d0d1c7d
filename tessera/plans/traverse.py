"""Breadth-first traversal of an edge table, for many starting points at once.

Each hop joins the frontier with the edges, keeps the best arrival at each node by a pre-aggregated minimum, and drops nodes seen
before. Hops are written to the shared folder, so lineage doesn't grow with depth and lost executors cost a reread.
"""

from __future__ import annotations

import tempfile
import uuid
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame, name: str = "hop") -> DataFrame:
    """``df`` written to the shared folder and read back."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bfs(seeds: DataFrame, edges: DataFrame, max_depth: int | None, reverse: bool = False, stop: DataFrame | None = None, keep_path: bool = False) -> DataFrame:
    """(anchor, node, depth[, parent, path]) for each node within ``max_depth`` hops (any number for None) of each anchor, at its least depth.

    seeds: (anchor, node), depth 0. edges: (src, dst), followed backwards with ``reverse``. Nodes in ``stop`` (node) are
    reached but not left. Of arrivals at the same depth, the one from the smallest parent counts. Null ends are never
    followed; cycles end because a node is entered once per anchor.
    """
    ends = ("dst", "src") if reverse else ("src", "dst")
    hop = edges.select(F.col(ends[0]).alias("at"), F.col(ends[1]).alias("to")).filter("at is not null and to is not null").distinct()
    base = seeds.select("anchor", "node").filter("node is not null").distinct().withColumn("depth", F.lit(0)).withColumn("parent", F.lit(None).cast("long"))
    if keep_path:
        base = base.withColumn("path", F.array("node"))
    seen = frontier = cut(base)
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        leaving = frontier.join(stop.select("node"), "node", "left_anti") if stop is not None else frontier
        step = leaving.join(hop, leaving["node"] == hop["at"])
        value = F.struct(F.col("node").alias("parent"), *([F.col("path")] if keep_path else []))
        best = step.groupBy("anchor", "to").agg(F.min(value).alias("v"))
        new = best.select("anchor", F.col("to").alias("node"), F.lit(depth).alias("depth"), "v.*")
        if keep_path:
            new = new.withColumn("path", F.concat("path", F.array("node")))
        new = new.join(seen.select("anchor", "node"), ["anchor", "node"], "left_anti")
        frontier = cut(new.select(*seen.columns))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def leaves(walk: DataFrame) -> DataFrame:
    """The rows of a walk that no other row has as its parent."""
    parents = walk.select("anchor", F.col("parent").alias("node")).filter("node is not null").distinct()
    return walk.join(parents, ["anchor", "node"], "left_anti")
