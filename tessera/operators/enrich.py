"""Service-level objectives and distributed traces joined to the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C

OUTBOUND, INBOUND = ("RPC_CLIENT", "CLIENT"), ("RPC_SERVER", "SERVER")


def slo_routes(slos: DataFrame, functions: DataFrame) -> DataFrame:
    """(slo_id, fn_id): objectives and the handlers they watch; a method counts only where the objective has one.

    Normalized routes repeat, so patterns meet distinct routes, and the matches meet the handlers by equality.
    """
    h = functions.filter("is_handler").withColumn("route", C.normalize_route(F.col("http_path")))
    s = slos.filter("path_pattern is not null").select("slo_id", C.normalize_route(F.col("path_pattern")).alias("pattern"), F.col("http_method").alias("method"))
    distinct = h.select("route", "http_method").distinct()
    fits = C.slo_matches(F.col("pattern"), F.col("route")) & (F.col("method").isNull() | (F.upper("method") == F.upper("http_method")))
    return distinct.join(s, fits).select("slo_id", "route", "http_method").join(h.select("route", "http_method", "fn_id"), ["route", "http_method"]).select("slo_id", "fn_id")


def service_level(slos: DataFrame) -> DataFrame:
    """Objectives without a path pattern."""
    return slos.filter("path_pattern is null")


def service_matches(slo_id: Column, local: str) -> Column:
    """The service slug in an id equals the local name, or one holds the other without marks; true without a slug."""
    slug = F.regexp_extract(slo_id, r"services?/([^/]+)", 1)
    plain = F.regexp_replace(F.lower(slug), "[^a-z0-9]", "")
    import re

    mine = re.sub("[^a-z0-9]", "", local.lower())
    return (slug == "") | (slug == local) | plain.contains(mine) | F.lit(mine).contains(plain)


def slo_from_tags(raw: DataFrame) -> DataFrame:
    """Objectives of a JSON export with tags: path from ``path:`` or ``endpoint:``, method from ``method:``."""
    tag = lambda *keys: F.coalesce(*[F.get(F.transform(F.filter("tags", lambda t: t.startswith(k + ":")), lambda t: F.substring(t, len(k) + 2, 1 << 20)), 0) for k in keys])  # noqa: E731, B023
    return raw.select(F.col("id").alias("slo_id"), "name", tag("path", "endpoint").alias("path_pattern"), F.upper(tag("method")).alias("http_method"))


def slo_from_text(raw: DataFrame) -> DataFrame:
    """Objectives whose path stands in their name or description."""
    path = lambda c: F.nullif(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), r"(/[A-Za-z0-9_{}:*./-]+)", 1), F.lit(""))
    return raw.select(F.col("id").alias("slo_id"), "name", F.coalesce(path("name"), path("description")).alias("path_pattern"), F.lit(None).cast("string").alias("http_method"))


def remote_patterns(spans: DataFrame) -> DataFrame:
    """(service, n, p99_ms, callers): calls to other services, from spans sent outwards.

    A span whose service has an inbound span in the same trace is the workspace's own and doesn't count. p99 is by nearest
    rank; callers are the distinct services of parent spans.
    """
    own = spans.filter(F.col("kind").isin(*INBOUND)).select("trace_id", "service").distinct()
    out = spans.filter(F.col("kind").isin(*OUTBOUND)).join(own, ["trace_id", "service"], "left_anti")
    parents = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("service").alias("caller"))
    with_caller = out.join(parents, ["trace_id", "parent_span_id"], "left")
    return with_caller.groupBy("service").agg(F.count("*").alias("n"), F.expr("percentile_disc(0.99) within group (order by latency_ms)").alias("p99_ms"), F.countDistinct("caller").alias("callers"))


def own_hosts(spans: DataFrame) -> DataFrame:
    """(service, n): outbound spans that the workspace's own inbound spans exclude."""
    own = spans.filter(F.col("kind").isin(*INBOUND)).select("trace_id", "service").distinct()
    return spans.filter(F.col("kind").isin(*OUTBOUND)).join(own, ["trace_id", "service"], "left_semi").groupBy("service").agg(F.count("*").alias("n"))


def observed_routes(urls: DataFrame) -> DataFrame:
    """(method, route, n) from (method, url): dynamic segments starred, method ANY where there is none."""
    return urls.select(F.coalesce("method", F.lit("ANY")).alias("method"), C.observed_path(F.col("url")).alias("route")).groupBy("method", "route").agg(F.count("*").alias("n"))


def service_of(labels: Column, name: Column) -> Column:
    """A span's service by its labels, then its URL's host, then its name."""
    host = F.regexp_extract(F.coalesce(labels["http.url"], F.lit("")), r"^[a-z]+://([^/?#]+)", 1)
    return F.coalesce(labels["peer.service"], labels["rpc.service"], C.host_service(F.nullif(F.coalesce(labels["http.host"], host), F.lit(""))), F.nullif(F.regexp_extract(name, r"^([A-Za-z0-9_.-]+)[/.]", 1), F.lit("")))


def latency_ms(start: Column, end: Column) -> Column:
    """Milliseconds, null where the end is before the start."""
    return F.when(end >= start, F.unix_millis(end) - F.unix_millis(start))


def caller_files(spans: DataFrame, functions: DataFrame) -> DataFrame:
    """(span_id, file_id): handlers' files whose name stands in a span's name, by the words of both."""
    words = spans.select("span_id", F.explode(F.split("name", r"[^A-Za-z0-9_]+")).alias("word"))
    return words.join(functions.select(F.col("name").alias("word"), "file_id"), "word").select("span_id", "file_id").distinct()


def http_caller_files(uses: DataFrame, libs: DataFrame) -> DataFrame:
    return uses.join(libs.filter("category = 'HttpClient'").select("lib_id"), "lib_id", "left_semi").select(F.col("src").alias("file_id")).distinct()


def remote_edges(uses: DataFrame, libs: DataFrame, services: DataFrame) -> DataFrame:
    """(src, service): each HTTP client file to each remote service, once; services are a handful of names, checked."""
    files = http_caller_files(uses, libs)
    return files.crossJoin(services.select("service").distinct()).select(F.col("file_id").alias("src"), "service")
