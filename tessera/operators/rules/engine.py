"""The rule contract, the registry and evaluation.

A rule reads one fact table and reports its rows that fit a predicate, in files that have (semi-join) or lack
(anti-join) certain facts. It is a declaration: ``rule_sql`` states a rule as a query, and ``evaluate`` runs those chosen
together over shared scans of the fact tables; nothing is collected.

Fact tables: ``calls`` (file_id, callee, args, fn, flags, line), ``marks`` (file_id, kind, name, text, fn, flags, line)
for everything an extractor marks (handlers of exceptions, goroutines, unsafe blocks, HTTP calls, routes, ...),
``imports`` (file_id, module) and ``files`` (file_id, path, language). ``flags`` is a comma-separated list in commas.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

TABLES = ("calls", "marks", "imports", "files")


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(column: str, *parts: str) -> str:
    return "(" + " or ".join(f"position({quote(p)} in {column}) > 0" for p in parts) + ")"


def starts(column: str, *parts: str) -> str:
    return "(" + " or ".join(f"left({column}, {len(p)}) = {quote(p)}" for p in parts) + ")"


def ends(column: str, *parts: str) -> str:
    return "(" + " or ".join(f"right({column}, {len(p)}) = {quote(p)}" for p in parts) + ")"


def eq(column: str, *values: str) -> str:
    return f"{column} in ({', '.join(map(quote, values))})"


def flag(name: str) -> str:
    return f"position(',{name},' in r.flags) > 0"


def lacks(name: str) -> str:
    return f"position(',{name},' in r.flags) = 0"


def kind(*kinds: str) -> str:
    return eq("r.kind", *kinds)


def lines_near(predicate: str, after: int) -> str:
    """No call that fits within the next lines: a predicate over ``n``, the nearby call."""
    return f"not exists (select 1 from calls n where n.file_id = r.file_id and n.line > r.line and n.line <= r.line + {after} and {predicate})"


@dataclass(frozen=True)
class Rule:
    """``where`` is over ``r``, the row of ``table``.

    imports / no_imports: some / no module of the file holds one of the parts. calls / no_calls, marks / no_marks: some /
    no row of that table (as ``x``) fits. at_least: so many fitting rows per file (or function, with ``per``); one row,
    the first line, is reported then. workspace_without: nothing is reported if any import of any file holds one of these.
    """

    id: str
    table: str
    where: str
    severity: str = "'Medium'"
    dimension: str = "Stability"
    imports: tuple = ()
    no_imports: tuple = ()
    calls: str = ""
    no_calls: str = ""
    marks: str = ""
    no_marks: str = ""
    at_least: int = 0
    per: str = ""
    workspace_without: tuple = ()
    samples: tuple = field(default=())

    @property
    def language(self) -> str:
        return {"fastapi": "python"}.get(self.id.split(".")[0], self.id.split(".")[0])


def rule_sql(rule: Rule) -> str:
    """(rule_id, file_id, line, severity, dimension) of a rule's findings."""
    conditions = [f"({rule.where})", f"r.file_id in (select file_id from files where language = {quote(rule.language)})"]
    of_file = lambda table, fits: f"r.file_id in (select x.file_id from {table} x where {fits})"
    but_not = lambda table, fits: f"not exists (select 1 from {table} x where x.file_id = r.file_id and {fits})"
    if rule.imports:
        conditions.append(of_file("imports", has("x.module", *rule.imports)))
    if rule.no_imports:
        conditions.append(but_not("imports", has("x.module", *rule.no_imports)))
    for table, fits, make in (("calls", rule.calls, of_file), ("calls", rule.no_calls, but_not), ("marks", rule.marks, of_file), ("marks", rule.no_marks, but_not)):
        if fits:
            conditions.append(make(table, fits))
    if rule.workspace_without:
        conditions.append(f"(select count(*) from imports x where {has('x.module', *rule.workspace_without)}) = 0")
    line = "1" if rule.table == "files" else "r.line"
    head = f"select {quote(rule.id)} as rule_id, r.file_id"
    tail = f"from {rule.table} r where {' and '.join(conditions)}"
    if rule.at_least:
        keys = ", ".join(["r.file_id", *([f"r.{rule.per}"] if rule.per else [])])
        return f"{head}, min({line}) as line, {rule.severity} as severity, {quote(rule.dimension)} as dimension {tail} group by {keys} having count(*) >= {rule.at_least}"
    return f"{head}, {line} as line, {rule.severity} as severity, {quote(rule.dimension)} as dimension {tail}"


def registry() -> dict[str, Rule]:
    from . import go, python, rust, typescript

    return {r.id: r for m in (python, go, rust, typescript) for r in m.RULES}


def union_sql(rules) -> str:
    return "\nunion all\n".join(rule_sql(r) for r in rules)


def _run(sql: str, facts: dict[str, DataFrame], **more: DataFrame) -> DataFrame:
    """SQL over the fact tables and ``more``, by name."""
    import re

    frames = facts | more
    sql = sql.replace("{", "{{").replace("}", "}}")  # braces in patterns would read as parameters
    sql = re.sub(rf"\b(from|join) ({'|'.join(frames)})\b", r"\1 {\2}", sql)
    return facts["files"].sparkSession.sql(sql, **{t: f for t, f in frames.items() if f"{{{t}}}" in sql})


def _simple(rule: Rule) -> bool:
    """Whether a rule is a test of a row and of its file alone."""
    return not (rule.at_least or rule.workspace_without or "select" in rule.where)


def _gates(rules: list[Rule], facts: dict[str, DataFrame]) -> DataFrame:
    """(file_id, allowed): per file, the numbers of the rules whose file-level conditions hold, from one aggregate of each table."""
    tests: dict[str, list[str]] = {"imports": [], "calls": [], "marks": []}

    def some(table: str, fits: str) -> str:
        if fits not in tests[table]:
            tests[table].append(fits)
        return f"coalesce({table}_{tests[table].index(fits)}, false)"

    allowed = []
    for k, r in enumerate(rules):
        parts = [f"f.language = {quote(r.language)}"]
        parts += [some("imports", has("x.module", *r.imports))] if r.imports else []
        parts += ["not " + some("imports", has("x.module", *r.no_imports))] if r.no_imports else []
        for table, yes, no in (("calls", r.calls, r.no_calls), ("marks", r.marks, r.no_marks)):
            parts += [some(table, yes)] if yes else []
            parts += ["not " + some(table, no)] if no else []
        allowed.append(f"case when {' and '.join(parts)} then {k} end")
    joins, frames = "", {}
    for table, fits in tests.items():
        if fits:
            flags = ", ".join(f"bool_or({t}) as {table}_{n}" for n, t in enumerate(fits))
            frames[f"{table}_gates"] = _run(f"select x.file_id, {flags} from {table} x group by x.file_id", facts)
            joins += f" left join {table}_gates g_{table} on g_{table}.file_id = f.file_id"
    return _run(f"select f.file_id, filter(array({', '.join(allowed)}), k -> k is not null) as allowed from files f{joins}", facts, **frames)


def evaluate(facts: dict[str, DataFrame], ids=None) -> DataFrame:
    """The findings of the chosen rules (all without ``ids``), in no order. facts: a DataFrame for each of TABLES.

    Rules that test a row and its file share one aggregate and one scan of each fact table, whatever their number; those
    with thresholds or conditions on other rows run as queries of their own.
    """
    rules = [r for k, r in registry().items() if ids is None or k in set(ids)]
    spark = facts["files"].sparkSession
    out = spark.createDataFrame([], "rule_id string, file_id long, line int, severity string, dimension string")
    shared = [r for r in rules if _simple(r)]
    gates = _gates(shared, facts).filter("size(allowed) > 0") if shared else None
    for table in TABLES:
        mine = [(k, r) for k, r in enumerate(shared) if r.table == table]
        if mine:
            line = "1" if table == "files" else "r.line"
            found = [f"case when array_contains(g.allowed, {k}) and ({r.where}) then named_struct('rule_id', {quote(r.id)}, 'severity', {r.severity}, 'dimension', {quote(r.dimension)}) end" for k, r in mine]
            hit = f"filter(array({', '.join(found)}), h -> h is not null)"
            rows = _run(f"select r.file_id, {line} as line, explode_outer({hit}) as h from {table} r join gates g on g.file_id = r.file_id", facts, gates=gates).filter("h is not null")
            out = out.unionByName(rows.selectExpr("h.rule_id", "file_id", "line", "h.severity", "h.dimension"))
    own = [r for r in rules if not _simple(r)]
    return out.unionByName(_run(union_sql(own), facts)) if own else out
