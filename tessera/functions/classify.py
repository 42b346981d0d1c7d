"""Ordered classifiers as Column expressions: the first pattern that fits decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_of(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    return reduce(lambda rest, r: F.when(r[0], F.lit(r[1])).otherwise(rest), reversed(rules), F.lit(otherwise))


def any_in(c: Column, parts) -> Column:
    return reduce(Column.__or__, [c.contains(p) for p in parts])


def any_end(c: Column, ends) -> Column:
    return reduce(Column.__or__, [c.endswith(e) for e in ends])


def any_start(c: Column, starts) -> Column:
    return reduce(Column.__or__, [c.startswith(s) for s in starts])


#: Directories that discovery drops.
EXCLUDED_DIRS = ("target", "node_modules", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".gocache")
LANGUAGES = {"py": "python", "go": "go", "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript"}


def language_of(path: Column) -> Column:
    ext = F.lower(F.element_at(F.split(path, r"\."), -1))
    return first_of([(ext == e, name) for e, name in LANGUAGES.items()])


def excluded(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, EXCLUDED_DIRS)))


def is_test_file(path: Column, language: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    dirs = F.arrays_overlap(F.split(path, "/"), F.array(F.lit("tests"), F.lit("test"), F.lit("__tests__")))
    by_name = (
        F.when(language == "python", name.startswith("test_") | name.endswith("_test.py") | name.endswith("_tests.py") | (name == "conftest.py"))
        .when(language == "go", name.endswith("_test.go"))
        .when(language == "rust", name.startswith("test_") | name.endswith("_test.rs"))
        .when(language == "typescript", name.rlike(r"\.(test|spec)\.[jt]sx?$"))
        .otherwise(False)
    )
    return dirs | by_name


def package_name(module: Column) -> Column:
    return F.element_at(F.split(module, r"[./]"), 1)


#: Of each category, in order, what a lower-case module name holds, is, or begins with.
CATEGORIES = (
    ("Observability", ("opentelemetry", "open_telemetry", "ddtrace", "datadog_lambda", "sentry_sdk", "sentry-sdk", "opentracing", "jaeger", "zipkin", "aws_xray", "aws-xray"), ("sentry", "otel"), ("sentry.", "otel.")),
    ("Logging", ("structlog", "uber.org/zap", "zerolog"), ("logging", "tracing", "winston", "pino"), ("logging.", "tracing::")),
    ("HttpClient", ("requests", "httpx", "aiohttp", "urllib", "axios", "fetch", "got", "reqwest", "hyper"), (), ()),
    ("Database", ("sqlalchemy", "prisma", "typeorm", "sequelize", "diesel", "sqlx", "gorm", "database/sql"), (), ()),
    ("WebFramework", ("fastapi", "flask", "django", "express", "nestjs", "gin", "echo", "chi", "axum", "actix"), (), ()),
    ("AsyncRuntime", ("asyncio", "tokio", "async_std"), (), ()),
    ("Resilience", ("tenacity", "stamina", "retry", "backoff", "resilience"), (), ()),
)
#: What a module of a standard library begins with, as written.
STANDARD = ("os", "sys", "io", "time", "json", "re", "collections", "typing", "pathlib", "fmt", "net/", "std::")


def module_category(name: Column) -> Column:
    n = F.lower(name)
    rules = [(any_in(n, holds) if not equal else any_in(n, holds) | n.isin(*equal) | any_start(n, begins), category) for category, holds, equal, begins in CATEGORIES]
    return first_of([*rules, (any_start(name, STANDARD), "StandardLib")], "Other")


def decorator_role(text: Column) -> Column:
    t = F.lower(text)
    return first_of([
        (any_in(t, ("start_as_current_span", "traced", "instrument")), "Tracing"),
        (any_in(t, ("retry", "backoff")), "Retry"),
        (any_in(t, ("circuit",)), "CircuitBreaker"),
        (any_in(t, ("limit", "throttle")), "RateLimit"),
        (any_in(t, ("cache",)), "Cache"),
        (any_in(t, ("timeout",)), "Timeout"),
        (any_in(t, ("login_required", "auth", "permission")), "Auth"),
        (any_in(t, (".get(", ".post(", ".put(", ".delete(", ".patch(", "route(")), "Route"),
        (any_in(t, ("task",)), "Task"),
        (any_in(t, ("property", "staticmethod", "classmethod")), "Builtin"),
    ], "Other")


#: Parts of names that make or register an application; ends and parts of paths that start one.
FACTORIES = ("create_app", "create_server", "make_app", "build_app", "init_app")
WIRING = ("register_blueprint", "include_router", "add_url_rule", "mount")
START_FILES, START_PARTS = ("__init__.py", "app.py", "main.py", "wsgi.py"), ("/bootstrap/", "/components_config", "_config.py")


def caller_kind(name: Column, path: Column | None = None) -> Column:
    """By the function's name, else by its file's path where known."""
    n, p = F.lower(name), F.lower(F.coalesce(path if path is not None else F.lit(""), F.lit("")))
    starts = any_end(p, START_FILES) | any_in(p, START_PARTS)
    return first_of([(any_in(n, FACTORIES), "app_factory"), (any_in(n, WIRING), "wiring"), (starts, "entrypoint")], "business")


def callee_name(expr: Column) -> Column:
    """Up to the first bracket, without white space."""
    return F.regexp_replace(F.regexp_extract(expr, r"^([^(\[]*)", 1), r"\s+", "")


DB_VERBS = ("execute", "executemany", "fetchone", "fetchall", "fetchmany", "commit", "rollback", "query", "flush", "scalar", "scalars")
HTTP_VERBS = ("get", "post", "put", "patch", "delete", "head", "options", "request", "send")


def verb_of(name: Column) -> Column:
    """The last part of a lower-case callee name."""
    return F.substring_index(name, ".", -1)


def receiver_of(name: Column) -> Column:
    return F.regexp_replace(name, r"\.?[^.]*$", "")


def is_db_call(name: Column, verb: Column, receiver: Column) -> Column:
    """A database verb on a receiver that looks like a session, connection, cursor or model manager.

    name, verb and receiver are lower-case parts of the callee, computed once for all classifiers.
    """
    return name.contains(".objects.") | (verb.isin(*DB_VERBS) & any_in(receiver, ("session", "db", "conn", "cursor", "engine", "tx")))


def is_http_call(name: Column, verb: Column, receiver: Column) -> Column:
    return (name == "fetch") | (verb.isin(*HTTP_VERBS) & any_in(receiver, ("requests", "http", "client", "axios", "session")) & ~any_in(receiver, ("db",)))


def node_role(is_handler: Column, db: Column, http: Column) -> Column:
    return first_of([(is_handler, "handler"), (db, "db"), (http, "http_client")], "logic")


def statement_kind(name: Column, verb: Column) -> Column:
    """The kind of statement of a database call; model managers first."""
    manager = name.contains(".objects.")
    return first_of([
        (manager & verb.isin("filter", "get", "all", "first", "last", "exclude"), "select"),
        (manager & verb.isin("create", "bulk_create"), "insert"),
        (verb.isin("query", "fetchone", "fetchall", "fetchmany", "scalar", "scalars"), "select"),
        (verb.isin("add", "add_all", "insert"), "insert"),
        (verb.isin("update", "merge"), "update"),
        (verb.isin("delete", "remove"), "delete"),
        (verb == "commit", "commit"),
        (verb == "rollback", "rollback"),
        (verb.isin("execute", "executemany"), "raw"),
    ], "other")


#: HTTP method to statement kind.
METHOD_KIND = {"get": "select", "head": "select", "options": "select", "post": "insert", "put": "update", "patch": "update", "delete": "delete"}


def method_kind(method: Column) -> Column:
    return first_of([(F.lower(method) == m, k) for m, k in METHOD_KIND.items()], "other")


def callee_kind(expr: Column) -> Column:
    n = callee_name(expr)
    last = F.element_at(F.split(n, r"\."), -1)
    return first_of([
        (n.isin("len", "print", "open", "range", "str", "int", "dict", "list", "set", "isinstance", "eval"), "builtin"),
        (last.rlike("^[A-Z]"), "construct"),
        (n.contains("."), "method"),
    ], "function")


def instrumentor(expr: Column) -> Column:
    n = F.lower(expr)
    return F.when(n.contains("instrument"), first_of([(n.contains(k), v) for k, v in (("fastapi", "fastapi"), ("flask", "flask"), ("django", "django"), ("sqlalchemy", "sqlalchemy"), ("requests", "requests"), ("httpx", "httpx"), ("express", "express"))], "all"))


def signal_kind(name: Column) -> Column:
    n = F.lower(name)
    return first_of([(any_in(n, ("span", "trace")), "trace"), (any_in(n, ("log",)), "log"), (any_in(n, ("counter", "gauge", "histogram", "metric")), "metric"), (any_in(n, ("error", "exception", "capture")), "error")])


def normalize_route(path: Column) -> Column:
    """Parameters of any style become ``*``; lower case, no trailing slash, ``/`` for empty."""
    p = F.regexp_replace(F.lower(path), r"\{[^/}]*\}|<[^/>]*>|:[^/]+", "*")
    p = F.regexp_replace(p, "/+$", "")
    return F.when(p == "", "/").otherwise(p)


def slo_matches(pattern: Column, path: Column) -> Column:
    """``*`` fits all, ``p/**`` whatever begins with p, ``p/*`` one more segment or none, anything else itself; both normalized."""
    deep, one = F.regexp_replace(pattern, r"/\*\*$", ""), F.regexp_replace(pattern, r"/\*$", "")
    rest = F.when(path == one, F.lit("")).when(path.startswith(F.concat(one, F.lit("/"))), F.substring(path, F.length(one) + 2, F.length(path)))
    return F.when(pattern == "*", True).when(pattern.endswith("/**"), path.startswith(deep)).when(pattern.endswith("/*"), rest.isNotNull() & ~rest.contains("/")).otherwise(pattern == path)


def route_glob(pattern: str) -> str:
    """A search pattern as a regular expression, open at both ends: ``**`` crosses slashes, ``*`` doesn't."""
    import re

    return ".*".join("[^/]*".join(map(re.escape, part.split("*"))) for part in pattern.split("**"))


def dynamic_segment(s: Column) -> Column:
    return s.rlike("^[0-9]+$") | s.rlike("^[0-9a-fA-F-]{32,36}$") | (s.rlike("^[A-Za-z0-9]{8,}$") & s.rlike("[0-9]") & s.rlike("[A-Za-z]"))


def observed_path(url: Column) -> Column:
    """The path of a URL without host, query and fragment, dynamic segments as ``*``."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    out = F.array_join(F.transform(F.split(F.regexp_replace(path, "/+$", ""), "/"), lambda s: F.when(dynamic_segment(s), "*").otherwise(s)), "/")
    return F.when(out == "", "/").otherwise(out)


def host_service(host: Column) -> Column:
    """A service name: no port, a cluster-internal host by its first label, a public one whole."""
    h = F.element_at(F.split(host, ":"), 1)
    return F.when(h.endswith(".svc.cluster.local") | h.endswith(".internal"), F.element_at(F.split(h, r"\."), 1)).when(h.rlike(r"\.(com|org|net|io|dev)$"), h).otherwise(F.element_at(F.split(h, r"\."), 1))


def endpoint(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)


def url_protocol(uri: Column) -> Column:
    u = F.lower(uri)
    by_port = {5432: "postgres", 3306: "mysql", 6379: "redis", 27017: "mongodb", 9092: "kafka", 5672: "amqp", 443: "https", 80: "http"}
    scheme = F.regexp_extract(u, r"^([a-z][a-z0-9+.-]*)://", 1)
    return F.when(scheme != "", F.when(scheme.startswith("postgres"), "postgres").otherwise(scheme)).otherwise(first_of([(u.rlike(f":{p}(/|$)"), n) for p, n in by_port.items()], "unknown"))


def dynamic_uri(uri: Column) -> Column:
    return uri.rlike(r"\$\{|\{[A-Za-z_]|%s|os\.environ|process\.env|getenv")


def looks_like_url(s: Column) -> Column:
    return s.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://") | s.rlike(r":(5432|3306|6379|27017|9092|5672)(/|$)") | s.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+(/|$)")
