"""From rule rows to reported findings: ids, suppressions, settings, dimensions, profiles and patches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finding_id(rule: Column, path: Column, line: Column) -> Column:
    return F.concat_ws(":", rule, path, line.cast("string"))


def parse_suppressions(files: DataFrame, marker: str = "lint-ignore", header_lines: int = 10) -> DataFrame:
    """(file_id, comment_line, scope, rules) of comments ``<marker>[: rule, ...]`` in (file_id, content).

    With code before it on the line, it holds for that line; among the first lines with only comments and blank lines
    above it, for the file; else for the next line. No rules: all of them.
    """
    lines = files.select("file_id", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("at", "line")).withColumn("n", F.col("at") + 1)
    mark = rf"(#|//)\s*{re.escape(marker)}(?::\s*([A-Za-z0-9_.*, -]*))?"
    code = F.trim(F.regexp_replace("line", r"(#|//).*$", "")) != ""
    above = Window.partitionBy("file_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    d = lines.withColumn("code", code).withColumn("code_above", F.coalesce(F.max("code").over(above), F.lit(False)))
    d = d.filter(F.col("line").rlike(mark))
    scope = F.when(F.col("code"), "SameLine").when((F.col("n") <= header_lines) & ~F.col("code_above"), "File").otherwise("NextLine")
    rules = F.filter(F.transform(F.split(F.regexp_extract("line", mark, 2), ","), lambda r: F.trim(r)), lambda r: r != "")
    return d.select("file_id", F.col("n").alias("comment_line"), scope.alias("scope"), rules.alias("rules"))


def rule_fits(pattern: Column, rule: Column) -> Column:
    """``*`` or nothing, ``prefix.*``, the whole id, or its last part."""
    return (pattern == "") | (pattern == "*") | (rule == pattern) | (pattern.endswith(".*") & rule.startswith(F.regexp_replace(pattern, r"\*$", ""))) | (~pattern.contains(".") & rule.endswith(F.concat(F.lit("."), pattern)))


def suppress(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Findings (file_id, line, rule_id, ...) that no suppression of their file, line or previous line covers."""
    s = suppressions.select(F.col("file_id").alias("f"), "comment_line", "scope", F.when(F.size("rules") == 0, F.array(F.lit("*"))).otherwise(F.col("rules")).alias("rules"))
    hit = (
        (F.col("file_id") == F.col("f"))
        & ((F.col("scope") == "File") | ((F.col("scope") == "SameLine") & (F.col("line") == F.col("comment_line"))) | ((F.col("scope") == "NextLine") & (F.col("line") == F.col("comment_line") + 1)))
        & F.exists("rules", lambda p: rule_fits(p, F.col("rule_id")))
    )
    return findings.join(s, hit, "left_anti")


def apply_settings(findings: DataFrame, include=(), exclude=(), severities: dict[str, str] | None = None) -> DataFrame:
    """Keeps rules that fit an include glob (all without any) and no exclude glob, with severities put in place by rule id."""
    like = lambda g: F.col("rule_id").rlike("^" + ".*".join(map(re.escape, g.split("*"))) + "$")
    out = findings
    if include:
        keep = F.lit(False)
        for g in include:
            keep = keep | like(g)
        out = out.filter(keep)
    for g in exclude:
        out = out.filter(~like(g))
    for rule, severity in (severities or {}).items():
        out = out.withColumn("severity", F.when(F.col("rule_id") == rule, severity).otherwise(F.col("severity")))
    return out


def filter_dimensions(findings: DataFrame, dimensions=()) -> DataFrame:
    return findings.filter(F.col("dimension").isin(*dimensions)) if dimensions else findings


def compile_predicate(p: dict) -> Column:
    """A file predicate of a profile: language, path_glob, under, text_any, text_all, regex, all, any, not."""
    path, content = F.col("path"), F.col("content")
    (kind, v), = p.items()
    if kind == "language":
        return F.col("language") == v
    if kind == "path_glob":
        return path.rlike("^" + ".*".join("[^/]*".join(map(re.escape, x.split("*"))) for x in v.split("**")) + "$")
    if kind == "under":
        return path.startswith(v.rstrip("/") + "/")
    if kind == "regex":
        return content.rlike(v)
    parts = [content.contains(t) for t in v] if kind.startswith("text_") else [compile_predicate(q) for q in (v if isinstance(v, list) else [v])]
    out = parts[0]
    for q in parts[1:]:
        out = out | q if kind in ("text_any", "any") else out & q
    return ~out if kind == "not" else out


def resolve_profiles(profiles: DataFrame, wanted: DataFrame) -> DataFrame:
    """(profile_id, rule_id, place): each wanted profile's rules once, profiles by falling confidence, then id."""
    p = profiles.join(wanted.select("profile_id", "confidence"), "profile_id").select("profile_id", "confidence", F.posexplode("rules").alias("nth", "rule_id"))
    order = Window.partitionBy("rule_id").orderBy(F.desc("confidence"), "profile_id", "nth")
    return p.withColumn("r", F.row_number().over(order)).filter("r = 1").select("profile_id", "rule_id", "confidence", "nth")


def apply_patches(files: DataFrame, hunks: DataFrame) -> DataFrame:
    """(file_id, content, diff): files with their hunks (file_id, start, end, replacement) applied from the end backwards.

    Offsets are in characters; of hunks that overlap, the one that ends last is applied. Files without hunks are left out.
    """
    grouped = hunks.groupBy("file_id").agg(F.collect_list(F.struct("start", "end", "replacement")).alias("hunks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import difflib

        for pdf in batches:
            out = []
            for path, content, hs in zip(pdf["path"], pdf["content"], pdf["hunks"]):
                text, floor = content or "", len(content or "")
                for h in sorted(hs, key=lambda h: (-h["end"], -h["start"])):
                    if h["end"] <= floor:
                        text, floor = text[: h["start"]] + h["replacement"] + text[h["end"] :], h["start"]
                out.append((text, "".join(difflib.unified_diff((content or "").splitlines(True), text.splitlines(True), f"a/{path}", f"b/{path}", n=3))))
            yield pd.DataFrame({"file_id": pdf["file_id"], "content": [o[0] for o in out], "diff": [o[1] for o in out]})

    return files.select("file_id", "path", "content").join(grouped, "file_id").mapInPandas(run, "file_id long, content string, diff string")
