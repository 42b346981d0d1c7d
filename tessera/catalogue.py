"""Registered queries over the projected workspace, each over its whole tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import classify as C
from .operators import coverage, enrich, faults, findings, graph, risk, rules
from .operators.rules import engine, metrics
from .plans.traverse import cut
from .sources.workspace import Workspace, with_views
from .streaming.spans import remote_windows as windows_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}



def query(sql: str | None = None):
    """Registers a function of a workspace under its name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Workspace(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return add


# --- graph lookups -----------------------------------------------------------------------------------------------


@query("""select f.path, c.importers from (select dst, count(*) as importers from w_imports group by dst) c join w_files f on f.file_id = c.dst order by importers desc, path limit 20""")
def centrality(w):
    return graph.centrality(w.imports, w.files, 20)


@query("select distinct t.path as file, s.path as importer from w_imports i join w_files t on t.file_id = i.dst join w_files s on s.file_id = i.src")
def importers(w):
    return graph.importers(w.imports, w.files, F.lit(True))


@query("""select distinct f.path as file, 'internal' as kind, t.path as name from w_imports i join w_files f on f.file_id = i.src join w_files t on t.file_id = i.dst
union all select distinct f.path, 'library', l.name from w_uses u join w_files f on f.file_id = u.src join w_libs l on l.lib_id = u.lib_id""")
def dependencies(w):
    return graph.dependencies(w.imports, w.uses, w.files, w.libs, F.lit(True))


@query("select l.name as library, f.path from w_uses u join w_libs l on l.lib_id = u.lib_id join w_files f on f.file_id = u.src where l.name = 'lib_7'")
def library_users(w):
    return graph.library_users(w.uses, w.libs, w.files, "lib_7")


@query("""with d as (select f.path, coalesce(a.n, 0) as in_degree, coalesce(b.n, 0) as out_degree, coalesce(c.n, 0) as libraries, coalesce(e.n, 0) as calls from w_files f
left join (select dst, count(*) as n from w_imports group by dst) a on a.dst = f.file_id left join (select src, count(*) as n from w_imports group by src) b on b.src = f.file_id
left join (select src, count(*) as n from w_uses group by src) c on c.src = f.file_id
left join (select fn.file_id, count(*) as n from w_calls k join w_functions fn on fn.fn_id = k.dst group by fn.file_id) e on e.file_id = f.file_id)
select *, in_degree + out_degree + libraries + calls as total from d order by total desc, path limit 25""")
def critical_by_total(w):
    return graph.critical(w.imports, w.calls, w.functions, w.uses, w.files, "total", 25)


@query("""select 'files' as kind, count(*) as n from w_files union all select 'functions', count(*) from w_functions union all select 'handlers', count(*) from w_functions where is_handler
union all select 'libraries', count(*) from w_libs union all select 'slos', count(*) from w_slos union all select 'imports', count(*) from w_imports union all select 'calls', count(*) from w_calls
union all select 'uses_library', count(*) from w_uses union all select 'contains', count(*) from w_functions""")
def graph_stats(w):
    return graph.stats(w.files, w.functions, w.libs, w.imports, w.calls, w.uses, w.slos)


@query("""with d as (select f.language, coalesce(a.n, 0) as i, coalesce(b.n, 0) as o from w_files f left join (select dst, count(*) as n from w_imports group by dst) a on a.dst = f.file_id
left join (select src, count(*) as n from w_imports group by src) b on b.src = f.file_id)
select language, count(*) as files, count(*) filter (where i = 0 and o > 0) as entrypoints, count(*) filter (where i > 3) as central from d group by language""")
def workspace_overview(w):
    return graph.overview(w.files, w.imports)


@query("""select 'file' as kind, count(*) as n, list_sort(list(distinct path)) as names from w_files""")
def enumerate_files(w):
    return graph.enumerate_entities("file", w.files, w.functions, w.libs)


@query("select 'library' as kind, count(*) as n, list_sort(list(distinct name)) as names from w_libs")
def enumerate_libraries(w):
    return graph.enumerate_entities("library", w.files, w.functions, w.libs)


@query("""select 'route' as kind, count(*) as n, list_sort(list(distinct concat(http_method, ' ', http_path))) as names from w_functions where is_handler""")
def enumerate_routes(w):
    return graph.enumerate_entities("route", w.files, w.functions, w.libs)


@query("select f.path, n.http_method, n.http_path, n.name from w_functions n join w_files f on f.file_id = n.file_id where n.is_handler and n.http_method = 'GET'")
def routes_get(w):
    return graph.routes(w.functions, w.files, "get")


@query("select distinct n.http_method, n.http_path, n.name, f.path from w_functions n join w_files f on f.file_id = n.file_id where n.is_handler and regexp_matches(n.http_path, '/api/v1/.*/[^/]*')")
def handlers_glob(w):
    return graph.handlers(w.functions, w.files, "/api/v1/**/*")


@query("""select f.path, case when coalesce(a.n, 0) > 10 then 'hub' when coalesce(a.n, 0) > 5 then 'important' when coalesce(a.n, 0) > 0 then 'importers' else 'leaf' end as label from w_files f
left join (select dst, count(*) as n from w_imports group by dst) a on a.dst = f.file_id left join (select src, count(*) as n from w_imports group by src) b on b.src = f.file_id
where coalesce(a.n, 0) > 0 or coalesce(b.n, 0) > 5""")
def centrality_label(w):
    return graph.centrality_label(w.imports, w.files)


@query("""select t.path, count(distinct i.src) as importers from w_imports i join w_files s on s.file_id = i.src join w_files t on t.file_id = i.dst
where t.path like '%brand11%' and s.path not like '%brand11%' group by t.path""")
def brief_exports(w):
    return graph.brief_exports(w.imports, w.files, "brand11")


@query("""select s.path as source, array_to_string(list_sort(list(distinct t.path)), ',') as targets from w_imports i join w_files s on s.file_id = i.src join w_files t on t.file_id = i.dst
where t.path like '%brand11%' and s.path not like '%brand11%' group by s.path""")
def brief_incoming(w):
    return graph.brief_incoming(w.imports, w.files, "brand11")


@query("""with m as (select n.*, f.path like '%brand11%' as mine from w_functions n join w_files f on f.file_id = n.file_id),
c as (select k.dst, count(*) filter (where m.mine) as i, count(*) filter (where not m.mine) as o from w_calls k join m on m.fn_id = k.src group by k.dst)
select * from (select name, case when is_handler then 'handler' when coalesce(o, 0) > 0 and coalesce(i, 0) = 0 then 'external_callers' when coalesce(o, 0) = 0 and coalesce(i, 0) = 0 then 'unused_export' end as reason
from m left join c on c.dst = m.fn_id where mine) where reason is not null""")
def brief_entry_points(w):
    return graph.brief_entry_points(w.functions, w.calls, w.files, "brand11")


@query("""select fn_id, name, (case when lower(name) like '%fn%' then 0 else 0 end) + (case when contains(lower(name), '101') then 1 else 0 end) + (case when contains(lower(name), '110') then 1 else 0 end) as score from w_functions
where contains(lower(name), '101') or contains(lower(name), '110') order by score desc, name, fn_id limit 8""")
def suggest_callers(w):
    return graph.suggest(w.functions, "fn_101_110").withColumn("score", F.col("score").cast("int"))


@query("select n.fn_id, n.name, f.path from w_functions n join w_files f on f.file_id = n.file_id where lower(n.name) = '17' or lower(n.name) like '%\\_17' escape '\\' or lower(n.name) like '%.17'")
def resolve_name(w):
    return graph.resolve(w.functions, w.files, "17").select("fn_id", "name", "path")


# --- traversals ----------------------------------------------------------------------------------------------------


@query("""with recursive t as (select dst as anchor, src as file_id, 1 as depth from w_imports union all select t.anchor, i.src, t.depth + 1 from t join w_imports i on i.dst = t.file_id where t.depth < 3)
select anchor, file_id, min(depth) as depth from t where file_id <> anchor group by anchor, file_id""")
def transitive_importers_d3(w):
    return graph.transitive_importers(w.imports, w.files, 3)


@query("""with recursive e as (select src, dst from w_imports union select a.file_id, b.file_id from w_calls k join w_functions a on a.fn_id = k.src join w_functions b on b.fn_id = k.dst where a.file_id <> b.file_id),
t as (select dst as anchor, src as file_id, 1 as depth from e where dst = 17 union select t.anchor, e.src, t.depth + 1 from t join e on e.dst = t.file_id where t.depth < 6)
select anchor, file_id, min(depth) as depth from t where file_id <> anchor group by anchor, file_id""")
def impact_d6(w):
    """Of one target, as it is asked for."""
    return graph.impact(w.imports, w.calls, w.functions, w.files.filter("file_id = 17"), 6)


@query("""with recursive t as (select dst as anchor, src as fn, 1 as depth from w_calls union all select t.anchor, c.src, t.depth + 1 from t join w_calls c on c.dst = t.fn where t.depth < 5)
select anchor, name, 'business' as kind, min(depth) as depth from t join w_functions f on f.fn_id = t.fn where fn <> anchor group by anchor, name""")
def callers_d5(w):
    return graph.callers(w.calls, w.functions, w.functions, 5)


@query("""with recursive t as (select fn_id as anchor, fn_id as fn, 0 as depth, [fn_id] as path from w_functions where is_handler
union all select t.anchor, c.dst, t.depth + 1, list_append(t.path, c.dst) from t join w_calls c on c.src = t.fn where t.depth < 5)
select anchor, fn as leaf, depth, path from t where not exists (select 1 from t u where u.anchor = t.anchor and u.depth = t.depth + 1)""")
def flow_d5(w):
    return graph.flow(w.calls, w.functions.filter("is_handler"), 5)


@query("""with recursive t as (select fn_id as anchor, fn_id as fn, 0 as depth, [fn_id] as path from w_functions where is_handler
union all select t.anchor, c.dst, t.depth + 1, list_append(t.path, c.dst) from t join w_calls c on c.src = t.fn where t.depth < 4)
select anchor, fn as target, depth, path from t join w_functions f on f.fn_id = t.fn where f.is_handler and depth > 0""")
def shortest_paths_d4(w):
    h = w.functions.filter("is_handler")
    return graph.shortest_path(w.calls, h, h, 4)


@query("select a.fn_id as anchor, b.name from w_functions a join w_functions b on b.file_id = a.file_id and b.fn_id <> a.fn_id where a.is_handler")
def siblings(w):
    return graph.siblings(w.functions, w.functions.filter("is_handler"))


# --- risk ------------------------------------------------------------------------------------------------------------

RANKS = "case severity when 'Low' then 1 when 'Medium' then 2 when 'High' then 3 when 'Critical' then 4 else 0 end"
MODES = r"""case when regexp_matches(rule_id, '^(python\.(http|db|asyncio)\.missing_timeout|python\.sqlalchemy\.missing_query_timeout|python\.fastapi\.missing_request_timeout|go\.http_missing_timeout|go\.nethttp\.(server|handler)_missing_timeout|go\.frameworks\.gorm\.query_timeout|go\.frameworks\.grpc\.missing_deadline|typescript\.http_missing_timeout|rust\.grpc_no_deadline)') then 'SlowDeath'
 when regexp_matches(rule_id, '^((python|go|typescript|rust)\.unbounded_retry|(python|typescript)\.http\.missing_retry|go\.http_retry)') then 'RetryStorm'
 when regexp_matches(rule_id, '^(rust\.(blocking_in_async|uncancelled_tasks)|go\.(goroutine_leak|channel_never_closed))') then 'ZombieProcess'
 when regexp_matches(rule_id, '^((python|go|typescript|rust)\.missing_circuit_breaker|(python|typescript)\.http\.missing_circuit_breaker|(go|rust)\.http_missing_circuit_breaker)') then 'Cascade' end"""


@query("""with d as (select f.path, coalesce(a.n, 0)::double as i, coalesce(b.n, 0)::double as r, coalesce(c.n, 0)::double as g from w_files f left join (select dst, count(*) as n from w_imports group by dst) a on a.dst = f.file_id
left join (select u.src, count(*) as n from w_uses u join w_libs l on l.lib_id = u.lib_id where l.category in ('Database', 'HttpClient') group by u.src) b on b.src = f.file_id
left join (select file_id, count(*) as n from w_findings group by file_id) c on c.file_id = f.file_id),
m as (select greatest(max(i), 1) as mi, greatest(max(r), 1) as mr, greatest(max(g), 1) as mg from d)
select path, round(0.5::double * i / mi + 0.3::double * r / mr + 0.2::double * g / mg, 6) as score from d, m order by score desc, path limit 50""")
def rank_files(w):
    return risk.rank_files(w.files, w.imports, w.uses, w.libs, w.findings, 50)


@query(f"select finding_no, rule_id, {MODES} as mode from w_findings where {MODES} is not null")
def failure_modes(w):
    return risk.failure_modes(w.findings).select("finding_no", "rule_id", "mode")


BLAST = """e as (select distinct src as file_id from w_imports where src not in (select dst from w_imports)),
t as (select file_id as anchor, file_id as node, 0 as depth from w_files union select t.anchor, i.src, t.depth + 1 from t join w_imports i on i.dst = t.node where t.depth < 6),
d as (select distinct anchor, node from t),
b as (select d.anchor as file_id, count(*) filter (where d.node <> d.anchor) as affected, count(e.file_id) as entries from d left join e on e.file_id = d.node group by d.anchor)"""


@query(f"with recursive {BLAST} select file_id, affected, entries from b")
def blast_radius_d6(w):
    return risk.blast_radius(w.imports, w.files, risk.entrypoints(w.files, w.imports), 6)


@query(f"""with recursive {BLAST}, g as (select *, {MODES} as mode from w_findings), h as (select *, row_number() over (partition by mode, file_id order by finding_no) as n from g where mode is not null)
select mode, path, rule_id, affected, entries, case greatest({RANKS}, case when entries > 0 and affected > 3 then 4 when entries > 0 then 3 when affected > 3 then 2 else 0 end)
 when 1 then 'Low' when 2 then 'Medium' when 3 then 'High' when 4 then 'Critical' else 'Info' end as severity from h join b on b.file_id = h.file_id join w_files f on f.file_id = h.file_id where n = 1""")
def hazards(w):
    return risk.hazards(w.findings, w.imports, w.files, 6)


@query("select severity, count(*) as n from w_findings group by severity")
def severity_summary(w):
    return risk.severity_summary(w.findings)


@query("select severity, rule_id, count(*) as n, count(distinct file_id) as files from w_findings group by severity, rule_id")
def grouped_findings(w):
    return risk.grouped_findings(w.findings)


@query(f"select path, line, rule_id, severity, finding_no from w_findings g join w_files f on f.file_id = g.file_id where f.language = 'go' order by {RANKS} desc, path, line, rule_id, finding_no limit 5")
def changed_findings(w):
    return risk.changed_findings(w.findings, w.files, F.col("language") == "go")


@query("""with recursive a as (select f.file_id as node, 1 as priority, f.path as name from w_files f where f.file_id in (select src from w_imports) and f.file_id not in (select dst from w_imports)),
t as (select distinct file_id as start, file_id as node, 0 as hops, 1.0::double as nofail from w_findings union select t.start, i.src, t.hops + 1, t.nofail * 0.5::double from t join w_imports i on i.dst = t.node),
s as (select start, node, min(hops) as hops from t group by start, node),
b as (select start, min(struct_pack(p := priority, h := hops, n := name)) as b from s join a on a.node = s.node group by start)
select g.file_id, b.b.n as anchor, coalesce(b.b.h, 0) as hops, round(coalesce((1 - pow(0.5::double, b.b.h)) * 100, 0), 6) as risk from (select distinct file_id from w_findings) g left join b on b.start = g.file_id""")
def propagation(w):
    imports = cut(w.imports)  # read three times
    anchors = risk.entrypoints(w.files, imports).join(w.files, "file_id").select(F.col("file_id").alias("node"), F.lit(1).alias("priority"), F.col("path").alias("name"))
    return risk.propagation(w.findings.select("file_id").distinct(), imports.withColumn("kind", F.lit("Imports")), anchors)


# --- objectives and traces ---------------------------------------------------------------------------------------------

ROUTE = "regexp_replace(regexp_replace(lower({0}), '\\{{[^/}}]*\\}}|<[^/>]*>|:[^/]+', '*', 'g'), '/+$', '')"


def _route(c: str) -> str:
    return ROUTE.format(c)


@query(f"""with h as (select fn_id, http_method, {_route('http_path')} as route from w_functions where is_handler), s as (select slo_id, http_method as m, {_route('path_pattern')} as p from w_slos)
select slo_id, fn_id from s join h on (m is null or m = http_method) and case when p = '*' then true when right(p, 3) = '/**' then starts_with(route, left(p, length(p) - 3))
 when right(p, 2) = '/*' then route = left(p, length(p) - 2) or (starts_with(route, left(p, length(p) - 1)) and not contains(substr(route, length(p)), '/')) else p = route end""")
def slo_routes(w):
    return enrich.slo_routes(w.slos, w.functions)


@query(f"select fn_id, {_route('http_path')} as route from w_functions")
def route_normalized(w):
    return w.functions.select("fn_id", C.normalize_route(F.col("http_path")).alias("route"))


@query("""with own as (select distinct trace_id, service from w_spans where kind in ('RPC_SERVER', 'SERVER')),
o as (select s.* from w_spans s where kind in ('RPC_CLIENT', 'CLIENT') and not exists (select 1 from own where own.trace_id = s.trace_id and own.service = s.service))
select o.service, count(*) as n, quantile_disc(o.latency_ms, 0.99) as p99_ms, count(distinct p.service) as callers from o left join w_spans p on p.trace_id = o.trace_id and p.span_id = o.parent_span_id group by o.service""")
def remote_patterns_p99(w):
    return enrich.remote_patterns(w.spans)


@query("""select service, count(*) as n from w_spans s where kind in ('RPC_CLIENT', 'CLIENT') and exists (select 1 from w_spans o where o.kind in ('RPC_SERVER', 'SERVER') and o.trace_id = s.trace_id and o.service = s.service) group by service""")
def own_host_exclusion(w):
    return enrich.own_hosts(w.spans)


@query("""with p as (select regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '') as path from pages),
r as (select array_to_string(list_transform(string_split(regexp_replace(path, '/+$', ''), '/'), lambda s: case when regexp_matches(s, '^[0-9]+$') or regexp_matches(s, '^[0-9a-fA-F-]{32,36}$')
 or (regexp_matches(s, '^[A-Za-z0-9]{8,}$') and regexp_matches(s, '[0-9]') and regexp_matches(s, '[A-Za-z]')) then '*' else s end), '/') as r from p)
select 'ANY' as method, case when r = '' then '/' else r end as route, count(*) as n from r group by 2""")
def observed_routes(w):
    return enrich.observed_routes(w.table("pages").select(F.lit(None).cast("string").alias("method"), "url"))


@query("select page_id, regexp_extract(lower(url), '^([a-z][a-z0-9+.-]*)://', 1) as protocol, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) as endpoint from pages")
def url_protocol(w):
    return w.table("pages").select("page_id", C.url_protocol(F.col("url")).alias("protocol"), C.endpoint(F.col("url")).alias("endpoint"))


@query("select distinct u.src as file_id from w_uses u join w_libs l on l.lib_id = u.lib_id where l.category = 'HttpClient'")
def http_caller_files(w):
    return enrich.http_caller_files(w.uses, w.libs)


@query("select slo_id, name from w_slos where path_pattern is null")
def slo_service_level(w):
    return enrich.service_level(w.slos).select("slo_id", "name")


# --- coverage ------------------------------------------------------------------------------------------------------------

DB = "'session.commit', 'session.execute', 'cursor.fetchone', 'db.session.query', 'User.objects.filter'"
HTTP = "'requests.get', 'httpx.post', 'http.Get', 'fetch', 'axios.get'"
ROLE = f"case when callee in ({DB}) then 'db' when callee in ({HTTP}) then 'http_client' else 'logic' end"
BOUNDS = f"""t as (select fn_id as anchor, fn_id as fn from w_functions where is_handler union select t.anchor, c.dst from t join w_calls c on c.src = t.fn),
b as (select distinct t.anchor, s.fn_id, s.file_id, s.line, s.callee, {ROLE} as role from (select distinct anchor, fn from t) t join w_sites s on s.fn_id = t.fn where {ROLE} <> 'logic'),
seen as (select file_id from w_sites where callee = 'tracer.start_as_current_span' union select u.src from w_uses u join w_libs l on l.lib_id = u.lib_id where l.category = 'Observability')"""


def _bounds(w):
    return coverage.boundaries(w.functions, w.calls, w.sites), coverage.instrumented(w.sites, w.uses, w.libs)


@query(f"with recursive {BOUNDS} select role, count(*) as boundaries, count(*) filter (where file_id in (select file_id from seen)) as observed from (select distinct file_id, line, callee, role from b) group by role")
def coverage_summary(w):
    return coverage.coverage_summary(*_bounds(w))


@query(f"with recursive {BOUNDS} select callee, file_id, line, role, count(distinct anchor) as routes from b where file_id not in (select file_id from seen) group by callee, file_id, line, role")
def unobserved_boundaries(w):
    return coverage.unobserved(*_bounds(w))


@query(f"with recursive {BOUNDS} select callee, file_id, line, role, count(distinct anchor) as routes from b where role = 'db' and file_id not in (select file_id from seen) group by callee, file_id, line, role order by routes desc, callee, file_id, line limit 20")
def critical_unobserved(w):
    return coverage.critical_unobserved(*_bounds(w), "db", 20)


QUALITY = """d as (select distinct u.src as file_id from w_uses u join w_libs l on l.lib_id = u.lib_id where l.category = 'Logging'),
n as (select distinct i.src as file_id from w_imports i join d on d.file_id = i.dst),
q as (select f.file_id, f.path, case when d.file_id is not null then 'direct' when n.file_id is not null then 'via_import' else 'none' end as quality from w_files f left join d on d.file_id = f.file_id left join n on n.file_id = f.file_id)"""


@query(f"with {QUALITY} select file_id, path, quality from q")
def logging_quality(w):
    return coverage.logging_quality(w.files, w.imports, w.uses, w.libs)


@query(f"""with {QUALITY} select regexp_replace(path, '/[^/]*$', '') as dir, count(*) as files, count(*) filter (where quality = 'direct') as direct, count(*) filter (where quality = 'via_import') as via_import, count(*) filter (where quality = 'none') as none from q group by 1 having count(*) >= 5""")
def logging_clusters(w):
    return coverage.logging_clusters(coverage.logging_quality(w.files, w.imports, w.uses, w.libs))


@query("""select regexp_replace(path, '/[^/]*$', '') as dir, count(*) as files, count(*) filter (where f.file_id in (select u.src from w_uses u join w_libs l on l.lib_id = u.lib_id where l.category = 'Observability')) as present from w_files f group by 1 having count(*) >= 5""")
def metrics_clusters(w):
    return coverage.metrics_clusters(w.files, w.uses, w.libs)


@query("select distinct file_id, 'fastapi' as framework from w_sites where callee = 'FastAPIInstrumentor.instrument_app'")
def auto_instruments(w):
    return coverage.auto_instruments(w.sites)


STATEMENT = "case callee when 'session.commit' then 'commit' when 'session.execute' then 'raw' else 'select' end"


@query(f"select {STATEMENT} as statement, count(*) as n, count(*) filter (where in_loop) as in_loop from w_sites where callee in ({DB}) group by 1")
def statement_mix(w):
    return coverage.statement_mix(w.sites)


@query("select file_id, line, callee from w_sites where in_loop and callee in ('cursor.fetchone', 'db.session.query', 'User.objects.filter')")
def potential_n_plus_one(w):
    return coverage.potential_n_plus_one(w.sites)


@query(f"select callee, {ROLE} as role, case when callee in ('print', 'open', 'eval', 'len') then 'builtin' when callee = 'OrderService' or callee like '%.Get' then 'construct' when contains(callee, '.') then 'method' else 'function' end as kind, count(*) as n from w_sites group by 1, 2, 3")
def callee_classes(w):
    s = coverage.sites_with_roles(w.sites)
    return s.groupBy("callee", "role", C.callee_kind(F.col("callee")).alias("kind")).agg(F.count("*").alias("n"))


# --- rules and findings ----------------------------------------------------------------------------------------------------


def _facts(w):
    return {"calls": w.view("f_calls"), "marks": w.view("f_marks"), "imports": w.view("f_imports"), "files": w.files}


def _rules(language: str):
    ids = [k for k, r in rules.registry().items() if r.language == language]
    text = engine.union_sql([rules.registry()[k] for k in ids])
    heads = "calls as (select * from f_calls), marks as (select * from f_marks), imports as (select * from f_imports), files as (select * from w_files)"
    name = f"rules_{language}"
    QUERIES[name] = lambda spark, sf_dir: rules.evaluate(_facts(Workspace(spark, sf_dir)), ids)
    ORACLE[name] = with_views(f"with {heads} {text}")


for _language in ("python", "go", "rust", "typescript"):
    _rules(_language)


HALSTEAD = """a as (select fn_id, n_params, greatest(floor(2.5::double * n_lines), 1) as ops, greatest(floor(3.5::double * n_lines), 1) as base from f_sizes where n_lines >= 5),
b as (select fn_id, ops, base + n_params as opnds, greatest(floor(1.5::double * sqrt(ops)), 1) as n1, greatest(floor(2.0::double * sqrt(base)) + n_params, 1) as n2 from a),
c as (select fn_id, round((ops + opnds) * log2(n1 + n2), 6) as volume, round(n1 / 2 * (opnds / n2), 6) as difficulty, round((ops + opnds) * log2(n1 + n2) / 3000, 6) as bugs from b where ops >= 5)"""


@query(f"with {HALSTEAD} select * from (select *, case when volume > 1500 or difficulty > 40 or bugs > 1 then 'High' when volume > 1000 or difficulty > 30 or bugs > 0.5 then 'Medium' end as severity from c) where severity is not null")
def rule_halstead(w):
    return metrics.halstead(w.view("f_sizes"))


@query(r"""with n as (select doc_id as fn_id, regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g') as norm from documents), g as (select norm, min(fn_id) as first_id, count(*) as copies from n group by norm having count(*) > 1)
select n.fn_id, g.first_id, g.copies, 1.0::double as similarity from n join g on g.norm = n.norm where n.fn_id <> g.first_id""")
def rule_duplication(w):
    return metrics.duplicates(w.table("documents").select(F.col("doc_id").alias("fn_id"), F.col("text").alias("body")))


@query("""with s as (select file_id, min(line) as line from w_findings where rule_id = 'python.naive_datetime' group by file_id)
select g.finding_no, concat(g.rule_id, ':', f.path, ':', cast(g.line as varchar)) as id from w_findings g join w_files f on f.file_id = g.file_id
where not exists (select 1 from s where s.file_id = g.file_id and (g.line = s.line + 1) and starts_with(g.rule_id, 'go.'))""")
def suppressed_findings(w):
    s = w.findings.filter("rule_id = 'python.naive_datetime'").groupBy("file_id").agg(F.min("line").alias("comment_line")).withColumn("scope", F.lit("NextLine")).withColumn("rules", F.array(F.lit("go.*")))
    kept = findings.suppress(w.findings, s).join(w.files, "file_id")
    return kept.select("finding_no", findings.finding_id(F.col("rule_id"), F.col("path"), F.col("line")).alias("id"))


@query("select finding_no, rule_id, case when rule_id = 'go.goroutine_leak' then 'Low' else severity end as severity from w_findings where starts_with(rule_id, 'go.') or starts_with(rule_id, 'python.http.')")
def settings_filter(w):
    return findings.apply_settings(w.findings, ["go.*", "python.http.*"], ["rust.*"], {"go.goroutine_leak": "Low"}).select("finding_no", "rule_id", "severity")


#: Folders and names by a part's number, so that discovery meets every kind of path.
PLACES = """select file_id, concat(case file_id % 12 when 0 then 'target/' when 1 then 'a/node_modules/' when 2 then '.venv/lib/' when 3 then 'dist/' when 4 then 'build/' when 5 then '.pytest_cache/' when 6 then 'x/.ruff_cache/' when 7 then '.gocache/' when 8 then 'src/tests/' when 9 then 'a/__tests__/' else 'src/' end,
 case file_id % 5 when 0 then 'test_a' when 1 then 'a_test' when 2 then 'a.spec' when 3 then 'conftest' else 'latest' end, case file_id % 4 when 0 then '.py' when 1 then '.go' when 2 then '.rs' else '.ts' end) as path from w_files"""


@query(f"""with p as ({PLACES}) select path, case right(path, 3) when '.py' then 'python' when '.go' then 'go' when '.rs' then 'rust' else 'typescript' end as language,
 regexp_matches(path, '(^|/)(target|node_modules|[.]venv|venv|__pycache__|[.]mypy_cache|[.]pytest_cache|[.]ruff_cache|[.]tox|[.]gocache)/') as excluded,
 regexp_matches(path, '(^|/)(tests|test|__tests__)/') or (path like '%.py' and regexp_matches(path, '(^|/)(test_[^/]*|[^/]*_test|[^/]*_tests|conftest)[.]py$')) or (path like '%.go' and path like '%\\_test.go' escape '\\')
 or (path like '%.rs' and regexp_matches(path, '(^|/)(test_[^/]*|[^/]*_test)[.]rs$')) or (path like '%.ts' and regexp_matches(path, '[.](test|spec)[.]ts$')) as is_test, count(*) as n from p group by path""")
def file_discovery(w):
    p, places = F.col("path"), w.sql(PLACES).groupBy("path").agg(F.count("*").alias("n"))
    return places.select("path", C.language_of(p).alias("language"), C.excluded(p).alias("excluded"), C.is_test_file(p, C.language_of(p)).alias("is_test"), "n")


@query("select module, count(*) as n, string_split_regex(module, '[./]')[1] as package from f_imports group by module")
def packages(w):
    return w.view("f_imports").groupBy("module").agg(F.count("*").alias("n")).withColumn("package", C.package_name(F.col("module")))


@query("""with recursive t as (select fn_id as anchor, fn_id as fn, 0 as depth from w_functions union select t.anchor, c.src, t.depth + 1 from t join w_calls c on c.dst = t.fn where t.depth < 10)
select distinct t.anchor, f.http_method, f.http_path from t join w_functions f on f.fn_id = t.fn where f.is_handler""")
def fault_routes(w):
    return faults.fault_routes(w.calls, w.functions, w.functions)


@query("""with recursive t as (select fn_id as anchor, fn_id as fn, 0 as depth from w_functions where is_handler union select t.anchor, c.dst, t.depth + 1 from t join w_calls c on c.src = t.fn where t.depth < 10)
select distinct t.anchor, l.category, l.name as upstream from t join w_functions f on f.fn_id = t.fn join w_uses u on u.src = f.file_id join w_libs l on l.lib_id = u.lib_id where l.category in ('HttpClient', 'Database')""")
def fault_egress(w):
    return faults.egress_targets(w.calls, w.functions, w.uses, w.libs, w.functions.filter("is_handler"))


@query("""select time_bucket(interval '5 minutes', start_time) as start, time_bucket(interval '5 minutes', start_time) + interval '5 minutes' as "end", service, count(*) as n, round(sum(latency_ms), 4) as total_ms, max(latency_ms) as max_ms
from w_spans where kind in ('RPC_CLIENT', 'CLIENT') group by 1, 2, 3""")
def remote_windows(w):
    return windows_of(w.spans).withColumn("total_ms", F.round("total_ms", 4))


@query("select 'SLO-00' || i as id, name from (values (1, 'The Slow Death'), (2, 'The Retry Storm'), (3, 'The Zombie Process'), (4, 'The Thundering Herd'), (5, 'The Blackhole'), (6, 'The Cascade')) as v(i, name)")
def glossary(w):
    return risk.glossary(w.spark).select("id", "name")


@query("""with a as (select unnest(['latency-normal', 'latency-pareto', 'latency-window', 'bandwidth-48k-latency', 'mobile-3g']) as template, 'latency' as fault), b as (select unnest(['jitter-light', 'jitter-bidirectional', 'mobile-3g']) as template, 'jitter' as fault),
c as (select unnest(['bandwidth-64k', 'bandwidth-48k-latency', 'mobile-3g']) as template, 'bandwidth' as fault), d as (select unnest(['packet-loss', 'packet-loss-burst']) as template, 'packet-loss' as fault), e as (select unnest(['blackhole', 'blackhole-window']) as template, 'blackhole' as fault)
select *, template in ('latency-window', 'packet-loss-burst', 'blackhole-window') as scheduled from (select * from a union all select * from b union all select * from c union all select * from d union all select * from e)""")
def fault_templates(w):
    t = faults.templates(w.spark)
    with_fault = F.explode(F.transform(F.filter("flags", lambda x: x.startswith("--with-")), lambda x: F.substring(x, 8, 100))).alias("fault")
    return t.select("template", with_fault, F.exists("flags", lambda x: x.contains("-sched ")).alias("scheduled"))
