"""Worked cases: small hand-built graphs, spans, routes and source text."""

import random

from pyspark.sql import functions as F

from tessera.functions import classify as C
from tessera.operators import enrich, findings, graph, risk, rules
from tessera.operators.rules import metrics
from tessera.plans import traverse
from tessera.plans.traverse import bfs


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_bfs_cycles_depth_and_stop(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (None, 5)], "src long, dst long")
    seeds = spark.createDataFrame([(1, 1)], "anchor long, node long")
    assert rows(bfs(seeds, edges, 5).select("node", "depth")) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert rows(bfs(seeds, edges, 1).select("node", "depth")) == [(1, 0), (2, 1)]
    assert rows(bfs(seeds, edges, 5, stop=spark.createDataFrame([(2,)], "node long")).select("node")) == [(1,), (2,)]
    assert rows(bfs(seeds, edges, 5, reverse=True).select("node", "depth")) == [(1, 0), (2, 2), (3, 1)]
    assert bfs(seeds.limit(0), edges, 3).count() == 0


def test_propagation_chain(spark):
    imports = spark.createDataFrame([(1, 2, "Imports"), (2, 3, "Imports")], "src long, dst long, kind string")
    anchors = spark.createDataFrame([(1, 1, "main.py")], "node long, priority int, name string")
    files = spark.createDataFrame([(2,), (3,), (9,)], "file_id long")
    assert rows(risk.propagation(files, imports, anchors)) == [(2, "main.py", 1, 50.0), (3, "main.py", 2, 75.0), (9, None, 0, 0.0)]


def walked(files, edges, anchors, depth=None):
    """Propagation by a walk from each file, in the terms of its definition."""
    keep = {k: 1 - w for k, w in risk.WEIGHTS.items()}
    out = []
    for f in files:
        seen, front, k = {f: (0, 1.0)}, {f: 1.0}, 0
        while front and (depth is None or k < depth):
            k, new = k + 1, {}
            for s, d, kind in edges:
                if d in front and s not in seen:
                    new[s] = min(new.get(s, 9.0), front[d] * keep[kind])
            seen |= {n: (k, p) for n, p in new.items()}
            front = new
        found = [(pri, *seen[n], name) for n, pri, name in anchors if n in seen]
        _, hops, nofail, name = min(found, default=(0, 0, 1.0, None))
        out.append((f, name, hops, round((1 - nofail) * 100, 6)))
    return sorted(out, key=repr)


def test_propagation_of_kinds_priorities_and_cycles(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(40), rng.randrange(40), rng.choice(list(risk.WEIGHTS))) for _ in range(70)]
    anchors = [(rng.randrange(40), rng.randrange(3), f"a{k % 7}") for k in range(9)]
    files = list(range(42))
    got = lambda depth: rows(risk.propagation(spark.createDataFrame([(f,) for f in files], "file_id long"), spark.createDataFrame(edges + [(None, 3, "Calls"), (3, None, "Calls")], "src long, dst long, kind string"), spark.createDataFrame(anchors, "node long, priority int, name string"), depth))
    for depth in (None, 0, 2):
        assert got(depth) == walked(files, edges, anchors, depth)


def test_propagation_work_grows_with_edges(spark, monkeypatch):
    """Each hop writes a row per node at most, not one per pair of a file and what it reaches."""
    written = []
    monkeypatch.setattr(traverse, "cut", lambda df, *a, f=traverse.cut: written.append((out := f(df, *a)).count()) or out)
    edges = [(0, k, "Imports") for k in range(1, 41)] + [(a, b, "Imports") for a in range(50, 90) for b in (0, 100)]
    files = [(k,) for k in range(1, 41)]
    got = rows(risk.propagation(spark.createDataFrame(files, "file_id long"), spark.createDataFrame(edges, "src long, dst long, kind string"), spark.createDataFrame([(a, 1, f"e{a}") for a in range(50, 90)], "node long, priority int, name string")))
    assert got == sorted([(k, "e50", 2, 75.0) for (k,) in files], key=repr)
    assert sum(written) <= 2 * len(edges)  # not forty files by forty anchors


def test_severity_never_downgraded(spark):
    for base, entries, affected, want in ((4, 0, 0, 4), (1, 1, 9, 4), (1, 1, 0, 3), (1, 0, 9, 2), (3, 0, 9, 3), (1, 0, 0, 1)):
        assert one(spark, risk.effective_severity(F.lit(base), F.lit(entries), F.lit(affected))) == want


def test_ranker_puts_shared_database_first(spark):
    files = spark.createDataFrame([(1, "main.py"), (2, "auth.py"), (3, "db.py")], "file_id long, path string")
    imports = spark.createDataFrame([(1, 3), (2, 3)], "src long, dst long")
    uses = spark.createDataFrame([(3, 7)], "src long, lib_id long")
    libs = spark.createDataFrame([(7, "sqlalchemy", "Database")], "lib_id long, name string, category string")
    none = spark.createDataFrame([], "file_id long")
    assert rows(risk.rank_files(files, imports, uses, libs, none, 1)) == [("db.py", 0.8)]


def test_routes_and_objectives(spark):
    for a, b in (("/users/:id", "/users/*"), ("/users/{user_id}", "/users/*"), ("/Users/<id>/", "/users/*"), ("", "/"), ("/", "/")):
        assert one(spark, C.normalize_route(F.lit(a))) == b
    for pattern, path, want in (("/api/users/*", "/api/users/123/posts", False), ("/api/users/*", "/api/users/1", True), ("/api/users/*", "/api/users", True), ("/api/**", "/api/users/1/x", True), ("*", "/x", True), ("/a", "/a", True), ("/a", "/b", False)):
        assert one(spark, C.slo_matches(F.lit(pattern), F.lit(path))) is want
    assert one(spark, C.observed_path(F.lit("https://h.example/users/42/1b9d6bcd-bbfd-4b2d-9b5d-ab8dfbbd4bed?x=1#y"))) == "/users/*/*"
    assert one(spark, C.host_service(F.lit("inventory.shop.svc.cluster.local:80"))) == "inventory"
    assert C.route_glob("/a/*/b") == "/a/[^/]*/b"


def test_trace_aggregation(spark):
    spans = spark.createDataFrame([("t", 1, None, "RPC_CLIENT", "inventory", 50.0), ("t", 2, 1, "RPC_CLIENT", "inventory", 200.0), ("t", 3, None, "RPC_SERVER", "web", 9.0), ("t", 4, None, "CLIENT", "web", 5.0)], "trace_id string, span_id long, parent_span_id long, kind string, service string, latency_ms double")
    assert rows(enrich.remote_patterns(spans)) == [("inventory", 2, 200.0, 1)]
    assert rows(enrich.own_hosts(spans)) == [("web", 1)]
    assert enrich.remote_patterns(spans.limit(0)).count() == 0


def test_classifiers(spark):
    for text, role, kind in (("session.query(User)", "select", True), ("db.commit()", "commit", True), ("User.objects.create(x)", "insert", True), ("requests.get(u)", None, False)):
        name = F.lower(C.callee_name(F.lit(text)))
        assert one(spark, C.is_db_call(name, C.verb_of(name), C.receiver_of(name))) is kind
        if kind:
            assert one(spark, C.statement_kind(name, C.verb_of(name))) == role
    assert one(spark, C.module_category(F.lit("opentelemetry.sdk"))) == "Observability"
    assert one(spark, C.module_category(F.lit("pytest-httpx"))) == "HttpClient"  # the order decides, not the meaning
    assert one(spark, C.decorator_role(F.lit("@app.get('/x')"))) == "Route"
    assert one(spark, C.caller_kind(F.lit("register_blueprint_x"))) == "wiring"
    assert one(spark, C.caller_kind(F.lit("prune_cache"))) == "business" and one(spark, C.caller_kind(F.lit("f"), F.lit("src/Main.py"))) == "entrypoint"
    assert one(spark, C.module_category(F.lit("opentelemetry-instrumentation-requests"))) == "Observability" and one(spark, C.module_category(F.lit("net/http"))) == "StandardLib"
    assert one(spark, C.language_of(F.lit("a/b.tsx"))) == "typescript"
    assert one(spark, C.is_test_file(F.lit("a/test_x.py"), F.lit("python"))) is True
    assert one(spark, C.excluded(F.lit("a/node_modules/x.js"))) is True
    assert one(spark, C.url_protocol(F.lit("postgresql://h/db"))) == "postgres"
    assert one(spark, C.url_protocol(F.lit("cache:6379"))) == "redis"
    assert one(spark, C.dynamic_uri(F.lit("http://${HOST}/x"))) is True


def test_suppressions(spark):
    text = "# lint-ignore\nimport x\n\ndef f():\n    # lint-ignore: python.bare_except\n    pass\ny = 1  # lint-ignore: go.*\n"
    s = findings.parse_suppressions(spark.createDataFrame([(1, text), (2, None)], "file_id long, content string"))
    assert rows(s) == [(1, 1, "File", []), (1, 5, "NextLine", ["python.bare_except"]), (1, 7, "SameLine", ["go.*"])]
    f = spark.createDataFrame([(1, 6, "python.bare_except"), (1, 7, "go.race_condition"), (1, 7, "python.x")], "file_id long, line int, rule_id string")
    assert rows(findings.suppress(f, s.filter("scope <> 'File'"))) == [(1, 7, "python.x")]
    assert findings.suppress(f, s).count() == 0


def test_settings_profiles_and_patches(spark):
    f = spark.createDataFrame([("go.a", "Low"), ("go.b", "Low"), ("python.a", "Low")], "rule_id string, severity string")
    assert rows(findings.apply_settings(f, ["go.*"], ["*.b"], {"go.a": "High"})) == [("go.a", "High")]
    p = spark.createDataFrame([("web", ["r1", "r2"]), ("db", ["r2", "r3"])], "profile_id string, rules array<string>")
    got = findings.resolve_profiles(p, spark.createDataFrame([("web", 0.9), ("db", 0.5)], "profile_id string, confidence double"))
    assert rows(got.select("profile_id", "rule_id")) == [("db", "r3"), ("web", "r1"), ("web", "r2")]
    files = spark.createDataFrame([(1, "a.py", "abc\ndef\n"), (2, "b.py", "x")], "file_id long, path string, content string")
    hunks = spark.createDataFrame([(1, 0, 1, "A"), (1, 4, 7, "DEF")], "file_id long, start int, end int, replacement string")
    (out,) = findings.apply_patches(files, hunks).collect()
    assert out["content"] == "Abc\nDEF\n" and "+DEF" in out["diff"]
    docs = spark.createDataFrame([("src/api/x.py", "python", "import fastapi")], "path string, language string, content string")
    assert docs.filter(findings.compile_predicate({"all": [{"language": "python"}, {"path_glob": "src/**/*.py"}, {"text_any": ["fastapi", "flask"]}]})).count() == 1
    assert docs.filter(findings.compile_predicate({"not": {"under": "src"}})).count() == 0


def test_rules_fire_once(spark):
    facts = {
        "files": spark.createDataFrame([(1, "a.py", "python"), (2, "b.go", "go")], "file_id long, path string, language string"),
        "imports": spark.createDataFrame([(1, "asyncio")], "file_id long, module string"),
        "calls": spark.createDataFrame([(1, "eval", "x", "f", "", 3), (2, "eval", "x", "f", "", 3), (1, "asyncio.wait", "ts", "f", "", 4)], "file_id long, callee string, args string, fn string, flags string, line int"),
        "marks": spark.createDataFrame([(1, "bare_except", "", "except:", "f", "", 9), (2, "goroutine", "", "go f()", "f", ",anonymous,", 5)], "file_id long, kind string, name string, text string, fn string, flags string, line int"),
    }
    got = rows(rules.evaluate(facts, ["python.unsafe_eval", "python.bare_except", "python.asyncio.missing_timeout", "go.race_condition"]).select("rule_id", "file_id", "line", "severity"))
    assert got == [("go.race_condition", 2, 5, "High"), ("python.asyncio.missing_timeout", 1, 4, "Medium"), ("python.bare_except", 1, 9, "Medium"), ("python.unsafe_eval", 1, 3, "Critical")]
    assert rules.evaluate(facts, []).count() == 0


def test_metrics(spark):
    assert rows(metrics.halstead(spark.createDataFrame([(1, 4, 0), (2, 300, 2)], "fn_id long, n_lines int, n_params int")).select("fn_id", "severity")) == [(2, "High")]
    d = spark.createDataFrame([(1, "def f(): pass"), (2, "DEF f():   pass"), (3, "other")], "fn_id long, body string")
    assert rows(metrics.duplicates(d)) == [(2, 1, 2, 1.0)]


def test_lookups_with_hint_and_suggestions(spark):
    files = spark.createDataFrame([(1, "src/a.py"), (2, "src/b.py")], "file_id long, path string")
    f = spark.createDataFrame([(1, 1, "get_profile"), (2, 2, "get_profile"), (3, 1, "svc.profile"), (4, 1, "xprofile")], "fn_id long, file_id long, name string")
    assert rows(graph.resolve(f, files, "profile").select("fn_id")) == [(1,), (2,), (3,)]
    assert rows(graph.resolve(f, files, "profile", "b.py").select("fn_id")) == [(2,)]
    assert rows(graph.resolve(f, files, "profile", "zzz.py").select("fn_id")) == [(1,), (2,), (3,)]
    assert [r["fn_id"] for r in graph.suggest(f, "get the profile", 2).collect()] == [1, 2]
