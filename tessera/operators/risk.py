"""Importance ranking, failure modes, blast radius, hazards and risk propagation."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.traverse import bfs

#: Rule id prefixes of each failure mode, in order.
FAILURE_MODES = {
    "SlowDeath": (
        "python.http.missing_timeout", "python.db.missing_timeout", "python.asyncio.missing_timeout", "python.sqlalchemy.missing_query_timeout",
        "python.fastapi.missing_request_timeout", "go.http_missing_timeout", "go.nethttp.server_missing_timeout", "go.nethttp.handler_missing_timeout",
        "go.frameworks.gorm.query_timeout", "go.frameworks.grpc.missing_deadline", "typescript.http_missing_timeout", "rust.grpc_no_deadline",
    ),
    "RetryStorm": (
        "python.unbounded_retry", "python.http.missing_retry", "go.unbounded_retry", "go.http_retry", "typescript.unbounded_retry",
        "typescript.http.missing_retry", "rust.unbounded_retry",
    ),
    "ZombieProcess": ("rust.blocking_in_async", "go.goroutine_leak", "go.channel_never_closed", "rust.uncancelled_tasks"),
    "Cascade": (
        "python.missing_circuit_breaker", "python.http.missing_circuit_breaker", "go.missing_circuit_breaker", "go.http_missing_circuit_breaker",
        "typescript.missing_circuit_breaker", "typescript.http.missing_circuit_breaker", "rust.missing_circuit_breaker", "rust.http_missing_circuit_breaker",
    ),
}
#: The weights of edges, as the chance that a failure passes.
WEIGHTS = {"Calls": 0.8, "Imports": 0.5, "RemoteCall": 0.9, "MonitoredBy": 1.0, "Contains": 0.0}
RANKS = {"Info": 0, "Low": 1, "Medium": 2, "High": 3, "Critical": 4}


def severity_rank(c: str = "severity"):
    return F.coalesce(*[F.when(F.col(c) == s, n) for s, n in RANKS.items()], F.lit(0))


def severity_name(rank):
    return F.coalesce(*[F.when(rank == n, s) for s, n in RANKS.items()])


def rank_files(files: DataFrame, imports: DataFrame, uses: DataFrame, libs: DataFrame, findings: DataFrame, limit: int, risky=("Database", "HttpClient")) -> DataFrame:
    """Files by half the share of importers, three tenths of risky libraries and a fifth of findings; ties by path."""
    counted = lambda df, key, name: df.groupBy(F.col(key).alias("file_id")).agg(F.count("*").alias(name))
    risk = uses.join(libs.filter(F.col("category").isin(*risky)).select("lib_id"), "lib_id")
    d = files.select("file_id", "path")
    for part in (counted(imports, "dst", "i"), counted(risk, "src", "r"), counted(findings, "file_id", "f")):
        d = d.join(part, "file_id", "left")
    d = d.na.fill(0, ["i", "r", "f"])
    top = d.agg(*[F.greatest(F.max(c), F.lit(1)).cast("double").alias(f"max_{c}") for c in "irf"])
    score = sum(F.lit(w) * F.col(c).cast("double") / F.col(f"max_{c}") for w, c in ((0.5, "i"), (0.3, "r"), (0.2, "f")))
    return d.crossJoin(F.broadcast(top)).select("path", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "path").limit(limit)


def failure_modes(findings: DataFrame) -> DataFrame:
    """Findings with their failure mode: the first prefix that their rule begins with; those of none are left out."""
    mode = F.coalesce(*[F.when(F.col("rule_id").startswith(p), m) for m, prefixes in FAILURE_MODES.items() for p in prefixes])
    return findings.withColumn("mode", mode).filter("mode is not null")


def entrypoints(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Files that import others and that none imports."""
    return files.join(imports.select(F.col("src").alias("file_id")).distinct(), "file_id", "left_semi").join(imports.select(F.col("dst").alias("file_id")), "file_id", "left_anti").select("file_id")


def blast_radius(imports: DataFrame, seeds: DataFrame, entries: DataFrame, depth: int = 6) -> DataFrame:
    """(file_id, affected, entries): files that depend on each seed within ``depth`` imports, and how many are entry points."""
    walk = bfs(seeds.select(F.col("file_id").alias("anchor"), F.col("file_id").alias("node")), imports, depth, reverse=True)
    marked = walk.join(entries.select(F.col("file_id").alias("node"), F.lit(1).alias("entry")), "node", "left")
    return marked.groupBy(F.col("anchor").alias("file_id")).agg(F.count_if(F.col("depth") > 0).alias("affected"), F.count("entry").alias("entries"))


def effective_severity(rank, entries, affected):
    """Critical where an entry point and more than three files are reached, at least High with one, at least Medium with the other; never less than it was."""
    return F.greatest(rank, F.when((entries > 0) & (affected > 3), 4).when(entries > 0, 3).when(affected > 3, 2).otherwise(0))


def hazards(findings: DataFrame, imports: DataFrame, files: DataFrame, depth: int = 6) -> DataFrame:
    """One row per failure mode and file, from its first finding: mode, path, rule_id, severity, affected, entries."""
    first = Window.partitionBy("mode", "file_id").orderBy("finding_no")
    f = failure_modes(findings).withColumn("n", F.row_number().over(first)).filter("n = 1")
    radius = blast_radius(imports, f.select("file_id").distinct(), entrypoints(files, imports), depth)
    d = f.join(radius, "file_id").join(files.select("file_id", "path"), "file_id")
    return d.select("mode", "path", "rule_id", severity_name(effective_severity(severity_rank(), F.col("entries"), F.col("affected"))).alias("severity"), "affected", "entries")


def severity_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def grouped_findings(findings: DataFrame) -> DataFrame:
    """(severity, rule_id, n, files)."""
    return findings.groupBy("severity", "rule_id").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("files"))


def changed_findings(findings: DataFrame, files: DataFrame, changed, limit: int = 5) -> DataFrame:
    """The worst findings of changed files: by severity, path, line and rule."""
    f = findings.join(files.filter(changed).select("file_id", "path"), "file_id").withColumn("rank", severity_rank())
    return f.orderBy(F.desc("rank"), "path", "line", "rule_id", "finding_no").limit(limit).select("path", "line", "rule_id", "severity", "finding_no")


def propagation(findings_files: DataFrame, edges: DataFrame, anchors: DataFrame, depth: int | None = None) -> DataFrame:
    """(file_id, anchor, hops, risk): how likely a failure in a file reaches its best anchor, in percent.

    edges: (src, dst, kind), followed from ``dst`` to ``src``: who depends on what fails. A path's risk is one less the
    product of (1 - weight) over its edges. anchors: (node, priority, name); the lowest priority wins, then fewest hops,
    least chance of not failing, smallest name. Of paths of the same length, the one with the least such chance counts. Without an
    anchor, risk is 0. The walk ends where nothing new is reached, or after ``depth`` hops.

    The walk starts at the anchors and goes from ``src`` to ``dst``, all of them at once: a node keeps only its best anchor
    within the hops walked, so work grows with the edges, not with pairs of files and what they reach. A node's best anchor is
    that of a neighbour one hop nearer; an edge that always passes a failure makes all anchors behind it alike, so nodes also
    keep the smallest name of all of theirs. An edge of no known kind leaves the chance unknown, and the risk 0.
    """
    from ..plans.traverse import cut

    weight = F.coalesce(*[F.when(F.col("kind") == k, w) for k, w in WEIGHTS.items()])
    hop = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), (1 - weight).alias("keep")).filter("at is not null and to is not null")
    hop = cut(hop.groupBy("at", "to").agg(F.min("keep").alias("keep")))

    def best(df: DataFrame, hops: int) -> DataFrame:
        by = df.groupBy("node").agg(F.min(F.struct("priority", "nofail", "name")).alias("b"), F.min(F.struct("priority", "least")).alias("l"))
        return by.select("node", "b.priority", F.lit(hops).alias("hops"), "b.nofail", "b.name", "l.least")

    seen = frontier = cut(best(anchors.filter("node is not null").select("node", "priority", F.lit(1.0).alias("nofail"), "name", F.col("name").alias("least")), 0))
    for k in count(1):
        if depth is not None and k > depth:
            break
        step = frontier.join(hop, frontier["node"] == hop["at"])
        step = step.select(F.col("to").alias("node"), "priority", (F.col("nofail") * F.col("keep")).alias("nofail"), F.when(F.col("keep") == 0, F.col("least")).otherwise(F.col("name")).alias("name"), "least")
        had = seen.select(F.col("node").alias("n2"), F.col("priority").alias("p2"))
        new = best(step, k).join(had, (F.col("node") == F.col("n2")) & (F.col("p2").isNull() | (F.col("p2") <= F.col("priority"))), "left_anti")
        frontier = cut(new)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    found = seen.join(findings_files.select(F.col("file_id").alias("node")), "node", "left_semi").groupBy(F.col("node").alias("start")).agg(F.min(F.struct("priority", "hops", "nofail", "name")).alias("b"))
    out = findings_files.join(found, findings_files["file_id"] == found["start"], "left")
    return out.select("file_id", F.col("b.name").alias("anchor"), F.coalesce("b.hops", F.lit(0)).alias("hops"), F.round(F.coalesce((1 - F.col("b.nofail")) * 100, F.lit(0.0)), 6).alias("risk"))


#: Ids and names of the glossary; the meanings are our own words.
GLOSSARY = (
    ("SLO-001", "The Slow Death", "Calls without a limit pile up until nothing is left to serve with."),
    ("SLO-002", "The Retry Storm", "Clients repeat failed calls and keep a service down."),
    ("SLO-003", "The Zombie Process", "Work that nobody waits for any more holds memory and handles."),
    ("SLO-004", "The Thundering Herd", "Many clients wake at once and ask for the same thing."),
    ("SLO-005", "The Blackhole", "Requests go in and no answer comes out."),
    ("SLO-006", "The Cascade", "A failure passes to the services that depend on the failed one."),
)


def glossary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GLOSSARY, "id string, name string, meaning string")
