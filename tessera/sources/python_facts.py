"""Facts of Python sources: functions, imports, calls and marks, by the standard parser inside one Arrow pass."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "file_id long, fact string, name string, text string, args string, fn string, flags string, line int, end_line int"
HTTP = {"requests", "httpx", "aiohttp"}
VERBS = {"get", "post", "put", "patch", "delete", "head", "options"}


class _Walk(ast.NodeVisitor):
    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.fn: list[str] = []
        self.loops = self.asyncs = self.withs = 0

    def add(self, fact: str, name: str, text: str, node: ast.AST, args: str = "", flags: tuple = ()) -> None:
        marks = [f for f, on in (("in_loop", self.loops), ("in_async", self.asyncs), ("in_with", self.withs)) if on] + list(flags)
        self.rows.append((fact, name, text, args, self.fn[-1] if self.fn else None, "," + ",".join(marks) + "," if marks else "", node.lineno, getattr(node, "end_lineno", node.lineno)))

    def _function(self, node, is_async: bool) -> None:
        for d in node.decorator_list:
            self.add("decorator", ast.unparse(d).split("(")[0], ast.unparse(d), d)
            call = d if isinstance(d, ast.Call) else None
            if call and isinstance(call.func, ast.Attribute) and call.func.attr in VERBS and call.args and isinstance(call.args[0], ast.Constant):
                self.add("route", call.func.attr.upper(), str(call.args[0].value), node)
        self.add("function", node.name, ast.unparse(node.args), node, flags=("async",) if is_async else ())
        outer = self.loops, self.asyncs, self.withs
        self.loops, self.asyncs, self.withs = 0, int(is_async), 0
        self.fn.append(node.name)
        for part in node.body:
            self.visit(part)
        self.fn.pop()
        self.loops, self.asyncs, self.withs = outer

    def visit_FunctionDef(self, node) -> None:
        self._function(node, False)

    def visit_AsyncFunctionDef(self, node) -> None:
        self._function(node, True)

    def visit_ClassDef(self, node) -> None:
        self.add("class", node.name, ",".join(ast.unparse(b) for b in node.bases), node)
        self.generic_visit(node)

    def visit_Import(self, node) -> None:
        for a in node.names:
            self.add("import", a.name, a.asname or "", node)

    def visit_ImportFrom(self, node) -> None:
        module = "." * node.level + (node.module or "")
        self.add("import", module, ",".join(a.name for a in node.names), node)

    def _loop(self, node) -> None:
        self.loops += 1
        self.generic_visit(node)
        self.loops -= 1

    visit_For = visit_AsyncFor = visit_While = visit_ListComp = visit_SetComp = visit_DictComp = visit_GeneratorExp = _loop

    def _with(self, node) -> None:
        self.withs += 1
        self.generic_visit(node)
        self.withs -= 1

    visit_With = visit_AsyncWith = _with

    def visit_ExceptHandler(self, node) -> None:
        if node.type is None:
            self.add("bare_except", "", "except:", node)
        self.generic_visit(node)

    def visit_Assign(self, node) -> None:
        for t in node.targets:
            self.add("assignment", ast.unparse(t), ast.unparse(node.value), node, flags=() if self.fn else ("module_level",))
        self.generic_visit(node)

    def visit_AnnAssign(self, node) -> None:
        self.add("assignment", ast.unparse(node.target), f"{ast.unparse(node.target)}: {ast.unparse(node.annotation)}", node, flags=() if self.fn else ("module_level",))
        self.generic_visit(node)

    def visit_Call(self, node) -> None:
        callee = ast.unparse(node.func)
        args = ", ".join([*map(ast.unparse, node.args), *(f"{k.arg}={ast.unparse(k.value)}" if k.arg else f"**{ast.unparse(k.value)}" for k in node.keywords)])
        self.add("call", callee, "", node, args)
        parts = callee.split(".")
        if len(parts) > 1 and parts[0] in HTTP and parts[-1] in VERBS:
            self.add("http_call", parts[-1].upper(), f"{callee}({args})", node, flags=("timeout",) if any(k.arg == "timeout" for k in node.keywords) else ())
        if parts[-1] in ("FastAPI", "Flask"):
            self.add("app", parts[-1], f"{callee}({args})", node)
        if parts[-1] == "add_middleware" and node.args:
            self.add("middleware", ast.unparse(node.args[0]), args, node)
        self.generic_visit(node)


def facts_of(source: str | None) -> list[tuple]:
    """(fact, name, text, args, fn, flags, line, end_line) rows; none for text that isn't Python."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    walk = _Walk()
    walk.visit(tree)
    return walk.rows


def extract(files: DataFrame) -> DataFrame:
    """Fact rows of all Python files of (file_id, language, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *r) for i, text in zip(pdf["file_id"], pdf["content"]) for r in facts_of(text)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.filter("language = 'python'").select("file_id", "content").mapInPandas(run, SCHEMA)


def tables(files: DataFrame, facts: DataFrame) -> dict[str, DataFrame]:
    """The rules' fact tables."""
    call = facts.filter("fact = 'call'").select("file_id", F.col("name").alias("callee"), "args", "fn", "flags", "line")
    marks = facts.filter("fact not in ('call', 'import')").select("file_id", F.col("fact").alias("kind"), "name", "text", "fn", "flags", "line")
    imports = facts.filter("fact = 'import'").select("file_id", F.concat_ws(".", "name", F.nullif("text", F.lit(""))).alias("module"))
    return {"calls": call, "marks": marks, "imports": imports, "files": files.select("file_id", "path", "language")}
