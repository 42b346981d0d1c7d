"""Graph queries over files, imports, functions, calls and library uses.

Single hops are joins and aggregates; anything deeper is one traversal for all starting points at once. Every ranked
result has a total order, so ties don't depend on the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..plans.traverse import bfs, leaves


def importers(imports: DataFrame, files: DataFrame, of: Column) -> DataFrame:
    """(file, importer): paths of the files that import each file for which ``of`` (over the file's columns) holds."""
    target = files.filter(of).select(F.col("file_id").alias("dst"), F.col("path").alias("file"))
    return imports.join(target, "dst").join(files.select(F.col("file_id").alias("src"), F.col("path").alias("importer")), "src").select("file", "importer").distinct()


def dependencies(imports: DataFrame, uses: DataFrame, files: DataFrame, libs: DataFrame, of: Column) -> DataFrame:
    """(file, kind, name): what a file imports inside the workspace, and the libraries it uses."""
    start = files.filter(of).select(F.col("file_id").alias("src"), F.col("path").alias("file"))
    inner = imports.join(start, "src").join(files.select(F.col("file_id").alias("dst"), F.col("path").alias("name")), "dst").select("file", F.lit("internal").alias("kind"), "name")
    outer = uses.join(start, "src").join(libs.select("lib_id", "name"), "lib_id").select("file", F.lit("library").alias("kind"), "name")
    return inner.unionByName(outer).distinct()


def library_users(uses: DataFrame, libs: DataFrame, files: DataFrame, name: str) -> DataFrame:
    lib = libs.filter(F.col("name") == name).select("lib_id", F.col("name").alias("library"))
    return uses.join(F.broadcast(lib), "lib_id").join(files.select(F.col("file_id").alias("src"), "path"), "src").select("library", "path")


def centrality(imports: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    """Files by the number of files that import them; ties by path."""
    degree = imports.groupBy(F.col("dst").alias("file_id")).agg(F.count("*").alias("importers"))
    return degree.join(files, "file_id").orderBy(F.desc("importers"), "path").limit(limit).select("path", "importers")


def critical(imports: DataFrame, calls: DataFrame, functions: DataFrame, uses: DataFrame, files: DataFrame, by: str, limit: int) -> DataFrame:
    """The first files by in_degree, out_degree, libraries, calls or total of these; ties by path."""
    count = lambda df, key, name: df.groupBy(F.col(key).alias("file_id")).agg(F.count("*").alias(name))
    called = calls.join(functions.select(F.col("fn_id").alias("dst"), "file_id"), "dst")
    m = files.select("file_id", "path")
    for part in (count(imports, "dst", "in_degree"), count(imports, "src", "out_degree"), count(uses, "src", "libraries"), count(called, "file_id", "calls")):
        m = m.join(part, "file_id", "left")
    m = m.na.fill(0).withColumn("total", F.col("in_degree") + F.col("out_degree") + F.col("libraries") + F.col("calls"))
    return m.orderBy(F.desc(by), "path").limit(limit).select("path", "in_degree", "out_degree", "libraries", "calls", "total")


def stats(files: DataFrame, functions: DataFrame, libs: DataFrame, imports: DataFrame, calls: DataFrame, uses: DataFrame, slos: DataFrame) -> DataFrame:
    """(kind, n) of every node and edge kind."""
    parts = [("files", files), ("functions", functions), ("handlers", functions.filter("is_handler")), ("libraries", libs), ("slos", slos), ("imports", imports), ("calls", calls), ("uses_library", uses), ("contains", functions)]
    out = None
    for kind, df in parts:
        row = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def overview(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Per language: files, entry points (import others, imported by none) and central files (more than three importers)."""
    inn = imports.groupBy(F.col("dst").alias("file_id")).agg(F.count("*").alias("inn"))
    out = imports.groupBy(F.col("src").alias("file_id")).agg(F.count("*").alias("out"))
    d = files.join(inn, "file_id", "left").join(out, "file_id", "left").na.fill(0, ["inn", "out"])
    return d.groupBy("language").agg(F.count("*").alias("files"), F.count_if((F.col("inn") == 0) & (F.col("out") > 0)).alias("entrypoints"), F.count_if(F.col("inn") > 3).alias("central"))


def enumerate_entities(kind: str, files: DataFrame, functions: DataFrame, libs: DataFrame) -> DataFrame:
    """(kind, n, names): the entities whose kind's name holds ``kind``, with their sorted names; each kind is one row."""
    sets = {"file": files.select(F.col("path").alias("name")), "function": functions.select("name"), "route": functions.filter("is_handler").select(F.concat_ws(" ", "http_method", "http_path").alias("name")), "library": libs.select("name")}
    out = None
    for name, df in sets.items():
        if kind in name:
            row = df.select(F.lit(name).alias("kind"), "name").groupBy("kind").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("name")).alias("names"))
            out = row if out is None else out.unionByName(row)
    return out


def resolve(functions: DataFrame, files: DataFrame, target: str, hint: str | None = None) -> DataFrame:
    """Functions of that name, exact or ending in it after ``_`` or ``.``, any case; a file hint narrows only if it leaves some."""
    n, t = F.lower("name"), target.lower()
    found = functions.filter((n == t) | n.endswith("_" + t) | n.endswith("." + t)).join(files.select("file_id", "path"), "file_id")
    if hint is None:
        return found
    fits = found.withColumn("fits", F.col("path").endswith(hint))
    return fits.crossJoin(F.broadcast(fits.agg(F.max("fits").alias("some")))).filter(F.col("fits") | ~F.col("some")).drop("fits", "some")


def routes(functions: DataFrame, files: DataFrame, method: str | None = None, file_part: str | None = None) -> DataFrame:
    r = functions.filter("is_handler").join(files.select("file_id", "path"), "file_id")
    if method:
        r = r.filter(F.upper("http_method") == method.upper())
    if file_part:
        r = r.filter(F.col("path").contains(file_part))
    return r.select("path", "http_method", "http_path", "name")


def handlers(functions: DataFrame, files: DataFrame, pattern: str) -> DataFrame:
    """Handlers whose route fits a glob, distinct."""
    fits = F.col("http_path").rlike(C.route_glob(pattern)) if "*" in pattern else F.col("http_path").contains(pattern)
    return routes(functions, files).filter(fits).select("http_method", "http_path", "name", "path").distinct()


def transitive_importers(imports: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(anchor, file_id, depth) of every file that reaches an anchor by imports."""
    walk = bfs(seeds.select(F.col("file_id").alias("anchor"), F.col("file_id").alias("node")), imports, depth, reverse=True)
    return walk.filter("depth > 0").select("anchor", F.col("node").alias("file_id"), "depth")


def callers(calls: DataFrame, functions: DataFrame, seeds: DataFrame, depth: int, business_only: bool = False) -> DataFrame:
    """(anchor, name, kind, depth) of functions that reach an anchor by calls, with the least depth per name."""
    walk = bfs(seeds.select(F.col("fn_id").alias("anchor"), F.col("fn_id").alias("node")), calls, depth, reverse=True).filter("depth > 0")
    named = walk.join(functions.select(F.col("fn_id").alias("node"), "name"), "node").groupBy("anchor", "name").agg(F.min("depth").alias("depth"))
    out = named.withColumn("kind", C.caller_kind(F.col("name")))
    return (out.filter("kind = 'business'") if business_only else out).select("anchor", "name", "kind", "depth")


def flow(calls: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(anchor, leaf, depth, path): root to leaf paths of the call tree under each anchor."""
    walk = bfs(seeds.select(F.col("fn_id").alias("anchor"), F.col("fn_id").alias("node")), calls, depth, keep_path=True)
    return leaves(walk).select("anchor", F.col("node").alias("leaf"), "depth", "path")


def shortest_path(calls: DataFrame, sources: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """(anchor, target, depth, path): a shortest call path from each source to each target within reach."""
    walk = bfs(sources.select(F.col("fn_id").alias("anchor"), F.col("fn_id").alias("node")), calls, depth, keep_path=True)
    return walk.join(targets.select(F.col("fn_id").alias("node")), "node").filter("depth > 0").select("anchor", F.col("node").alias("target"), "depth", "path")


def impact(imports: DataFrame, calls: DataFrame, functions: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(anchor, file_id, depth): files reached backwards over imports and calls, calls lifted to their files."""
    at = functions.select("fn_id", "file_id")
    lifted = calls.join(at.select(F.col("fn_id").alias("src"), F.col("file_id").alias("s")), "src").join(at.select(F.col("fn_id").alias("dst"), F.col("file_id").alias("d")), "dst").filter("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst"))
    walk = bfs(seeds.select(F.col("file_id").alias("anchor"), F.col("file_id").alias("node")), imports.select("src", "dst").unionByName(lifted).distinct(), depth, reverse=True)
    return walk.filter("depth > 0").select("anchor", F.col("node").alias("file_id"), "depth")


def siblings(functions: DataFrame, seeds: DataFrame) -> DataFrame:
    """(anchor, name): the other functions of an anchor's file."""
    s = functions.join(seeds.select("fn_id"), "fn_id", "left_semi").select(F.col("fn_id").alias("anchor"), "file_id")
    return functions.join(s, "file_id").filter("fn_id <> anchor").select("anchor", "name")


def suggest(functions: DataFrame, target: str, limit: int = 8) -> DataFrame:
    """Functions by the number of the target's tokens (three characters or more) that their names hold; ties by name."""
    import re

    tokens = [t for t in re.split(r"[^a-z0-9]+", target.lower()) if len(t) >= 3]
    score = sum((F.lower("name").contains(t).cast("int") for t in tokens), F.lit(0))
    return functions.select("fn_id", "name", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "name", "fn_id").limit(limit)


def brief_exports(imports: DataFrame, files: DataFrame, part: str) -> DataFrame:
    """(path, importers): files of a subtree that files outside it import."""
    inside, outside = files.filter(F.col("path").contains(part)), files.filter(~F.col("path").contains(part))
    cross = imports.join(outside.select(F.col("file_id").alias("src")), "src").join(inside.select(F.col("file_id").alias("dst"), "path"), "dst")
    return cross.groupBy("path").agg(F.countDistinct("src").alias("importers"))


def brief_incoming(imports: DataFrame, files: DataFrame, part: str) -> DataFrame:
    """(source, targets): per file outside a subtree, the files inside that it imports, sorted."""
    inside, outside = files.filter(F.col("path").contains(part)), files.filter(~F.col("path").contains(part))
    cross = imports.join(outside.select(F.col("file_id").alias("src"), F.col("path").alias("source")), "src").join(inside.select(F.col("file_id").alias("dst"), "path"), "dst")
    return cross.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("targets"))


def brief_entry_points(functions: DataFrame, calls: DataFrame, files: DataFrame, part: str) -> DataFrame:
    """(name, reason) of a subtree's entry points: a handler, else called only from outside, else never called."""
    inside = files.filter(F.col("path").contains(part)).select("file_id", F.lit(True).alias("mine"))
    f = functions.join(inside, "file_id", "left").select("fn_id", "name", "is_handler", F.coalesce("mine", F.lit(False)).alias("mine"))
    by = calls.join(f.select(F.col("fn_id").alias("src"), F.col("mine").alias("from_inside")), "src").groupBy(F.col("dst").alias("fn_id")).agg(F.count_if("from_inside").alias("inner"), F.count_if(~F.col("from_inside")).alias("outer"))
    d = f.filter("mine").join(by, "fn_id", "left").na.fill(0, ["inner", "outer"])
    reason = F.when(F.col("is_handler"), "handler").when((F.col("outer") > 0) & (F.col("inner") == 0), "external_callers").when((F.col("outer") == 0) & (F.col("inner") == 0), "unused_export")
    return d.select("name", reason.alias("reason")).filter("reason is not null")


def centrality_label(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, label): hub above ten importers, important above five, importers above none, leaf with more than five imports."""
    inn = imports.groupBy(F.col("dst").alias("file_id")).agg(F.count("*").alias("inn"))
    out = imports.groupBy(F.col("src").alias("file_id")).agg(F.count("*").alias("out"))
    d = files.join(inn, "file_id", "left").join(out, "file_id", "left").na.fill(0, ["inn", "out"])
    return d.select("path", F.when(F.col("inn") > 10, "hub").when(F.col("inn") > 5, "important").when(F.col("inn") > 0, "importers").when(F.col("out") > 5, "leaf").alias("label")).filter("label is not null")
