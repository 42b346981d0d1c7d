"""The workspace: files, libraries, imports, functions, calls, spans and objectives as DataFrames.

A workspace is built from facts that an extractor wrote, or projected from the star-schema tables by the views below,
which are plain SQL and run unchanged on any engine. Frames are lazy; nothing is read until a query needs it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from . import vocabulary

#: View by name, in order: each may read the tables and the views before it.
VIEWS = {
    "w_files": """select p_partkey as file_id, concat('src/', lower(replace(p_brand,'#','')), '/', replace(p_name,' ','_'), '_', cast(p_partkey as varchar(20)),
 case p_partkey % 4 when 0 then '.py' when 1 then '.go' when 2 then '.rs' else '.ts' end) as path,
 case p_partkey % 4 when 0 then 'python' when 1 then 'go' when 2 then 'rust' else 'typescript' end as language from part""",
    "w_libs": """select s_suppkey as lib_id, concat('lib_', cast(s_suppkey as varchar(20))) as name,
 case s_nationkey % 5 when 0 then 'HttpClient' when 1 then 'Database' when 2 then 'Logging' when 3 then 'Observability' else 'Other' end as category from supplier""",
    "w_imports": """select distinct l_partkey as src, (l_linenumber % 2 + 1) * 1000003 % (l_partkey + 1) as dst from lineitem
 where l_partkey <> (l_linenumber % 2 + 1) * 1000003 % (l_partkey + 1)""",
    "w_uses": "select distinct l_partkey as src, l_suppkey as lib_id from lineitem",
    "w_functions": """select o_orderkey as fn_id, cast(o_orderkey % (select count(*) from part) as bigint) as file_id, concat('fn_', cast(o_orderkey as varchar(20))) as name,
 o_orderpriority = '1-URGENT' as is_handler, case o_orderstatus when 'O' then 'GET' when 'F' then 'POST' else 'DELETE' end as http_method,
 concat('/api/v', cast(o_orderkey % 3 as varchar(20)), '/r', cast(o_custkey % 50 as varchar(20)), '/{id}') as http_path from orders""",
    "w_calls": """select src, dst from (select lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as src, o_orderkey as dst from orders) t where src is not null""",
    "w_spans": """select user_id as trace_id, event_id as span_id, lag(event_id) over (partition by user_id order by ts, event_id) as parent_span_id,
 case event_type when 'click' then 'RPC_CLIENT' when 'purchase' then 'CLIENT' when 'view' then 'RPC_SERVER' else 'INTERNAL' end as kind,
 concat('svc_', cast(event_id % 10 as varchar(20))) as service, value as latency_ms, ts as start_time from events""",
    "w_slos": """select n_nationkey as slo_id, n_name as name, case n_nationkey % 3 when 0 then concat('/api/v', cast(n_nationkey % 2 as varchar(20)), '/**')
 when 1 then concat('/api/v1/r', cast(n_nationkey as varchar(20)), '/*') else '/nomatch' end as path_pattern, case when n_regionkey = 0 then 'GET' else null end as http_method from nation""",
    "w_findings": """select l.doc_id as finding_no, cast(l.doc_id % (select count(*) from part) as bigint) as file_id, cast(l.doc_id % 90 + 1 as int) as line,
 case l.doc_id % 7 when 0 then 'python.http.missing_timeout' when 1 then 'go.goroutine_leak' when 2 then 'python.http.missing_retry' when 3 then 'rust.unsafe_unwrap'
 when 4 then 'go.unbounded_goroutines' when 5 then 'typescript.n_plus_one_queries' else 'python.naive_datetime' end as rule_id,
 case when l.quality = 0 and l.toxic = 1 then 'Critical' when l.quality = 0 then 'High' when l.toxic = 1 then 'Medium' else 'Low' end as severity from labels l""",
    "w_sites": """select l_orderkey * 8 + l_linenumber as site_id, l_partkey as file_id, l_orderkey as fn_id, cast(l_linenumber * 7 + l_quantity as int) as line,
 v.callee, case l_returnflag when 'A' then 'url, timeout=5' when 'N' then '"w"' else '' end as args,
 l_linestatus = 'O' as in_loop, l_linenumber % 2 = 0 as is_async from lineitem l
 join (values (0, 'requests.get'), (1, 'httpx.post'), (2, 'session.commit'), (3, 'session.execute'), (4, 'cursor.fetchone'), (5, 'asyncio.create_task'), (6, 'datetime.now'), (7, 'redis.set'), (8, 'db.session.query'), (9, 'print'), (10, 'open'), (11, 'eval'), (12, 'yaml.load'), (13, 're.compile'), (14, 'User.objects.filter'), (15, 'FastAPIInstrumentor.instrument_app'), (16, 'tracer.start_as_current_span'), (17, 'logger.info'), (18, 'http.Get'), (19, 'fetch'), (20, 'len'), (21, 'OrderService'), (22, 'axios.get'), (23, 'helpers.run')) as v(k, callee) on v.k = cast(l_quantity as int) % 24""",
}
VIEWS |= {
    "f_imports": f"""select u.src as file_id, v.word as module from w_uses u join w_files f on f.file_id = u.src
 join {vocabulary.values(vocabulary.IMPORTS)} as v(language, k, word) on v.language = f.language and v.k = (u.src * 3 + u.lib_id) % 16""",
    "f_calls": f"""select l.l_partkey as file_id, v.callee, v.args, v.flags, concat('fn_', cast(l.l_orderkey % 50 as varchar(20))) as fn, cast(l.l_linenumber * 9 + l.l_quantity as int) as line
 from lineitem l join w_files f on f.file_id = l.l_partkey
 join {vocabulary.values(vocabulary.CALLS)} as v(language, k, callee, args, flags) on v.language = f.language and v.k = (l.l_orderkey * 13 + l.l_linenumber * 7 + l.l_suppkey) % 24""",
    "f_marks": f"""select f.file_id, v.kind, v.name, v.text, v.flags, concat('fn_', cast(o.o_orderkey % 50 as varchar(20))) as fn, cast(o.o_orderkey % 120 + 1 as int) as line
 from orders o join w_files f on f.file_id = o.o_orderkey % (select count(*) from part)
 join {vocabulary.values(vocabulary.MARKS)} as v(language, k, kind, name, text, flags) on v.language = f.language and v.k = (o.o_custkey + o.o_orderkey * 5) % 16""",
    "f_sizes": "select o_orderkey as fn_id, cast(floor(o_totalprice) as bigint) % 400 as n_lines, o_custkey % 8 as n_params from orders",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


def with_views(sql: str) -> str:
    """``sql`` behind the views it reads, as common table expressions."""
    import re

    need: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in need and re.search(rf"\b{name}\b", text):
                add(VIEWS[name])
                need.append(name)

    add(sql)
    heads = ",\n".join(f"{n} as ({VIEWS[n]})" for n in need)
    body = sql.strip()
    if not heads:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {heads},\n{body[len('with recursive ') :]}"
    return f"with {heads},\n{body[5:]}" if body.lower().startswith("with ") else f"with {heads}\n{body}"


class Workspace:
    """The views of one data folder as DataFrames, by attribute: files, libs, imports, uses, functions, calls, spans, slos, findings, sites."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._frames: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._frames[name]

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Runs SQL over the tables, the views and ``frames``, all by name."""
        import re

        used = {n: self.table(n) for n in TABLES if re.search(rf"(?i)\b(from|join)\s+{n}\b", text)}
        used |= {n: self.view(n) for n in VIEWS if re.search(rf"\b{n}\b", text)} | frames
        text = text.replace("{", "{{").replace("}", "}}")
        for n in used:
            text = re.sub(rf"(?i)\b(from|join)\s+{n}\b", rf"\1 {{{n}}}", text)
        return self.spark.sql(text, **used) if used else self.spark.sql(text)

    def view(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self.sql(VIEWS[name])
        return self._frames[name]

    files = cached_property(lambda self: self.view("w_files"))
    libs = cached_property(lambda self: self.view("w_libs"))
    imports = cached_property(lambda self: self.view("w_imports"))
    uses = cached_property(lambda self: self.view("w_uses"))
    functions = cached_property(lambda self: self.view("w_functions"))
    calls = cached_property(lambda self: self.view("w_calls"))
    spans = cached_property(lambda self: self.view("w_spans"))
    slos = cached_property(lambda self: self.view("w_slos"))
    findings = cached_property(lambda self: self.view("w_findings"))
    sites = cached_property(lambda self: self.view("w_sites"))
