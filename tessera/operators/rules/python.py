"""Rules for Python facts."""

from .engine import Rule, ends, eq, flag, has, kind, lacks, starts

C, A, N, T = "r.callee", "r.args", "r.name", "r.text"
ORM = ("sqlalchemy", "django.db", "peewee", "tortoise")
WEB = ("fastapi", "flask", "django", "starlette")
RULES = [
    Rule("fastapi.missing_cors", "marks", kind("app"), dimension="Correctness", no_marks="x.kind = 'middleware' and position('CORSMiddleware' in x.text) > 0"),
    Rule("python.async_resource_cleanup", "calls", has(C, "httpx.AsyncClient", "aiohttp.ClientSession") + " and " + lacks("in_with")),
    Rule("python.async_task_no_error_handling", "calls", eq(C, "asyncio.create_task", "create_task")),
    Rule("python.asyncio.missing_timeout", "calls", f"({eq(C, 'asyncio.wait')} and not {has(A, 'timeout')}) or ({eq(C, 'asyncio.gather')} and not {has(A, 'return_exceptions')}) or ({ends(C, 'queue.get', 'lock.acquire', 'semaphore.acquire')} and not {has(A, 'timeout')})", imports=("asyncio",)),
    Rule("python.asyncio.uncancelled_tasks", "calls", eq(C, "asyncio.ensure_future", "ensure_future", "asyncio.create_task"), imports=("asyncio",), no_calls=has("x.callee", ".cancel", "all_tasks", "shutdown")),
    Rule("python.bare_except", "marks", kind("bare_except"), dimension="Correctness"),
    Rule("python.concurrency.race_condition_risk", "calls", has(C, "increment", "count"), "'High'", "Correctness", imports=("threading", "asyncio"), no_imports=("Lock",)),
    Rule("python.cpu_in_event_loop", "calls", flag("in_async") + " and " + has(C, "json.dumps", "json.loads", "hashlib.", "bcrypt.", "gzip.", "zlib.", "re.sub", "pickle.", "numpy.", "sorted") + " and not " + has(A, "executor"), dimension="Performance"),
    Rule("python.db.missing_timeout", "calls", ends(C, "create_engine", "connect", "create_pool") + " and not " + has(A, "timeout", "connect_args"), "'High'", imports=("sqlalchemy", "psycopg", "asyncpg")),
    Rule("python.db.missing_transaction_boundary", "calls", ends(C, ".add", ".delete", ".save", ".update", ".insert"), "'High'", "Correctness", imports=ORM, no_calls=has("x.callee", "begin", "transaction", "atomic", "commit"), at_least=2),
    Rule("python.django.insecure_allowed_hosts", "marks", kind("assignment") + f" and {eq(N, 'ALLOWED_HOSTS')} and ({has(T, '*')} or {eq(T, '[]')})", f"case when {has(T, '*')} then 'High' else 'Medium' end", imports=("django",)),
    Rule("python.django.insecure_session_settings", "marks", kind("assignment") + f" and {eq(N, 'SESSION_COOKIE_SECURE', 'SESSION_COOKIE_HTTPONLY')} and {eq(T, 'False')}", "'High'"),
    Rule("python.django.missing_csrf_protection", "calls", ends(C, "csrf_exempt"), "'High'"),
    Rule("python.django.missing_secure_settings", "marks", kind("assignment") + f" and ({eq(N, 'SECURE_SSL_REDIRECT', 'SECURE_CONTENT_TYPE_NOSNIFF', 'CSRF_COOKIE_SECURE')} and {eq(T, 'False')} or {eq(N, 'SECURE_HSTS_SECONDS')} and {eq(T, '0')})", f"case when {eq(N, 'SECURE_HSTS_SECONDS')} then 'Medium' else 'High' end"),
    Rule("python.django.orm_missing_select_related", "calls", flag("in_loop") + f" and {has(C, '.objects.')} and not {has(C, 'select_related', 'prefetch_related')}", dimension="Performance", imports=("django",)),
    Rule("python.ephemeral_filesystem_write", "calls", f"{eq(C, 'open')} and {has(A, '\"w', '\"a', '\"x')} or {ends(C, '.write_text', '.write_bytes', 'os.makedirs', 'shutil.copy')} or {has(C, 'tempfile.')}"),
    Rule("python.fastapi.missing_exception_handler", "marks", kind("app"), no_marks="x.kind = 'exception_handler'", imports=("fastapi",)),
    Rule("python.fastapi.missing_health_check", "marks", kind("app") + " and (select count(*) from marks h where h.kind = 'route' and (position('health' in h.text) > 0 or position('ready' in h.text) > 0 or position('live' in h.text) > 0 or position('ping' in h.text) > 0)) = 0", imports=("fastapi",)),
    Rule("python.fastapi.missing_input_validation", "marks", kind("route") + f" and {eq(N, 'POST', 'PUT', 'PATCH')} and {flag('untyped_body')}", imports=("fastapi",)),
    Rule("python.fastapi.missing_rate_limiting", "marks", kind("app"), imports=("fastapi",), no_imports=("slowapi", "fastapi_limiter", "ratelimit"), no_calls=has("x.callee", "limit", "rate", "throttle")),
    Rule("python.fastapi.missing_request_timeout", "marks", kind("app"), imports=("fastapi",), no_imports=("timeout",), no_calls="position('add_middleware' in x.callee) > 0 and position('Timeout' in x.args) > 0"),
    Rule("python.fastapi.request_body_unbounded", "marks", kind("route") + f" and {eq(N, 'POST', 'PUT', 'PATCH')} and {flag('raw_body')} and (select count(*) from marks m where m.kind = 'middleware' and (position('Limit' in m.text) > 0 or position('MaxBody' in m.text) > 0)) = 0", imports=("fastapi",)),
    Rule("python.flask.insecure_cookie_settings", "marks", kind("assignment") + f" and {has(N, 'SESSION_COOKIE_SECURE', 'SESSION_COOKIE_HTTPONLY')} and {eq(T, 'False')}", "'High'", imports=("flask",)),
    Rule("python.flask.missing_session_timeout", "marks", kind("app"), imports=("flask",), calls=has("x.callee", "session"), no_marks="x.kind = 'assignment' and position('PERMANENT_SESSION_LIFETIME' in x.name) > 0"),
    Rule("python.global_mutable_state", "marks", kind("assignment") + " and " + flag("module_level") + f" and ({starts(T, '[', '{', 'list(', 'dict(', 'set(')}) and not {eq(N, '__all__')}", f"case when upper({N}) = {N} then 'Low' else 'High' end"),
    Rule("python.grpc.missing_deadline", "calls", f"({ends(C, 'insecure_channel', 'secure_channel')} and not {has(A, 'options')}) or ({starts(C, 'stub.')} and not {has(A, 'timeout', 'deadline')})", "'High'", imports=("grpc",)),
    Rule("python.http.blocking_in_async", "marks", kind("http_call") + f" and {flag('in_async')} and {lacks('offloaded')} and {starts(T, 'requests.')}", "'High'", "Performance"),
    Rule("python.http.missing_retry", "marks", kind("http_call") + " and " + lacks("retry")),
    Rule("python.http.missing_timeout", "marks", kind("http_call") + " and " + lacks("timeout")),
    Rule("python.io_in_hot_path", "calls", flag("in_loop") + " and " + f"({eq(C, 'open')} or {starts(C, 'requests.', 'httpx.', 'os.', 'subprocess.', 'socket.', 'cursor.')})", "'High'", "Performance"),
    Rule("python.large_response_memory", "calls", f"{ends(C, '.read', 'json.load', 'pickle.load')} or ({ends(C, 'read_csv', 'read_json')} and not {has(A, 'chunksize', 'lines')})"),
    Rule("python.missing_correlation_id", "marks", kind("app"), imports=WEB, workspace_without=("correlation", "asgi_correlation_id")),
    Rule("python.missing_structured_logging", "calls", f"{eq(C, 'print')} or {starts(C, 'logging.', 'logger.')}", f"case when {eq(C, 'print')} then 'Medium' else 'Low' end", workspace_without=("structlog", "json_logging")),
    Rule("python.missing_tracing", "marks", kind("app"), imports=("fastapi",), workspace_without=("opentelemetry", "ddtrace", "jaeger_client", "newrelic")),
    Rule("python.n_plus_one_queries", "marks", kind("orm_query") + f" and ({flag('in_loop')} or {flag('in_comprehension')}) and {lacks('eager')}", "'High'", "Performance", imports=ORM),
    Rule("python.naive_datetime", "calls", f"({ends(C, 'datetime.now', 'fromtimestamp')} and not {has(A, 'tz', 'timezone')}) or {ends(C, 'utcnow', 'datetime.today')}", dimension="Correctness"),
    Rule("python.performance.unbounded_memory_operation", "calls", f"({ends(C, '.all', '.readlines')} or {starts(C, 'pd.read_')}) and not {has(A, 'limit', 'chunk', 'batch', 'yield_per', 'iter', 'stream')}", "'High'"),
    Rule("python.pydantic.arbitrary_types_allowed", "calls", f"{ends(C, 'ConfigDict')} and {has(A, 'arbitrary_types_allowed=True')}", imports=("pydantic",)),
    Rule("python.pydantic.missing_validators", "marks", kind("assignment") + f" and {has(N, 'email', 'url', 'password', 'secret', 'token', 'api_key')} and {has(T, ': str')}", f"case when {has(N, 'password', 'secret', 'token', 'api_key')} then 'Medium' else 'Low' end", imports=("pydantic",), no_imports=("EmailStr", "HttpUrl", "SecretStr")),
    Rule("python.recursive_no_base_case", "calls", f"({C} = r.fn or {C} = concat('self.', r.fn)) and " + lacks("default_param"), "'High'"),
    Rule("python.redis.missing_ttl", "calls", f"({ends(C, 'redis.set', 'cache.set')} and not {has(A, 'ex=', 'px=', 'timeout', 'ttl')}) or {ends(C, '.hset', '.hmset')}", imports=("redis", "cache")),
    Rule("python.redis.unbounded_keys", "calls", f"{has(C, 'redis.')} and {has(A, 'timestamp', 'uuid', 'f\"')}", f"case when {has(A, 'timestamp', 'uuid')} then 'High' else 'Medium' end", imports=("redis",)),
    Rule("python.regex_compile", "calls", f"{eq(C, 're.compile', 'regex.compile')} and r.fn is not null", "'Low'", "Performance"),
    Rule("python.resilience.missing_circuit_breaker", "marks", kind("http_call"), "'High'", no_imports=("circuitbreaker", "pybreaker")),
    Rule("python.resilience.missing_graceful_shutdown", "files", "true", "'High'", imports=WEB, no_imports=("signal", "atexit"), no_marks="x.kind = 'function' and (position('lifespan' in x.name) > 0 or position('shutdown' in x.name) > 0)"),
    Rule("python.resilience.missing_idempotency_key", "calls", f"{ends(C, 'PaymentIntent.create', 'Charge.create', 'Refund.create')} and not {has(A, 'idempotency_key')}", "'Critical'", imports=("stripe", "braintree")),
    Rule("python.sql_injection", "calls", f"{ends(C, 'execute', 'executemany')} and {has(f'upper({A})', 'SELECT ', 'INSERT ', 'UPDATE ', 'DELETE ')} and {has(A, 'f\"', '.format(', ' % ')}", "'Critical'", "Security"),
    Rule("python.sqlalchemy.lazy_loading_in_loop", "marks", kind("orm_query") + f" and {flag('in_loop')} and not {has(T, 'joinedload', 'selectinload', 'subqueryload')}", imports=("sqlalchemy",)),
    Rule("python.sqlalchemy.missing_connection_pool_config", "calls", f"{ends(C, 'create_engine', 'create_async_engine')} and not {has(A, 'NullPool')} and not ({has(A, 'pool_size')} and {has(A, 'max_overflow')} and {has(A, 'pool_recycle')} and {has(A, 'pool_pre_ping')})", imports=("sqlalchemy",)),
    Rule("python.sqlalchemy.missing_query_timeout", "calls", f"({ends(C, 'create_engine')} and not {has(A, 'connect_args', 'execution_options', 'timeout')}) or ({ends(C, 'session.execute', 'connection.execute', 'engine.execute', '.scalars')} and not {has(A, 'timeout')})", imports=("sqlalchemy",)),
    Rule("python.sqlalchemy.pgvector_suboptimal_query", "calls", f"{ends(C, 'execute', 'text')} and {has(A, '<=>')}", "'Low'", "Performance", imports=("pgvector", "sqlalchemy")),
    Rule("python.sqlalchemy.session_not_closed", "calls", ends(C, "Session", "sessionmaker") + " and " + lacks("in_with"), imports=("sqlalchemy",), no_calls=has("x.callee", ".close", ".remove")),
    Rule("python.sync_dns_lookup", "calls", ends(C, "gethostbyname", "gethostbyname_ex", "gethostbyaddr", "getaddrinfo", "getnameinfo", "getfqdn"), f"case when {flag('in_async')} then 'High' else 'Medium' end", "Performance", imports=("socket",)),
    Rule("python.unbounded_cache", "calls", f"{ends(C, 'functools.cache')} or ({ends(C, 'lru_cache')} and {has(A, 'maxsize=None')}) or ({has(C, 'cachetools.')} and not {has(A, 'maxsize', 'ttl')})"),
    Rule("python.unbounded_concurrency", "calls", ends(C, "create_task"), "'High'", at_least=4),
    Rule("python.unbounded_retry", "calls", f"({ends(C, 'tenacity.retry')} and not {has(A, 'stop')}) or ({starts(C, 'backoff.on_')} and not {has(A, 'max_tries', 'max_time')})", "'High'", imports=("tenacity", "backoff")),
    Rule("python.unsafe_eval", "calls", f"{eq(C, 'eval', 'exec')} or {ends(C, 'pickle.loads', 'pickle.load')} or ({ends(C, 'yaml.load')} and not {has(A, 'SafeLoader')}) or ({starts(C, 'subprocess.')} and {has(A, 'shell=True')})", f"case when {eq(C, 'eval', 'exec')} then 'Critical' else 'High' end", "Security"),
]
