"""Rules for TypeScript and JavaScript facts."""

from .engine import Rule, ends, eq, flag, has, kind, lacks, starts

C, A, N, T = "r.callee", "r.args", "r.name", "r.text"
SERVER = ("express", "fastify", "@nestjs", "koa", "http")
ORM = ("prisma", "typeorm", "sequelize", "mongoose")
RULES = [
    Rule("typescript.async_without_error_handling", "marks", kind("function") + f" and {flag('async')} and {lacks('try_catch')}"),
    Rule("typescript.bare_catch", "marks", kind("bare_catch"), dimension="Correctness"),
    Rule("typescript.console_in_production", "calls", starts(C, "console.") + " and " + lacks("test"), imports=SERVER),
    Rule("typescript.cpu_in_event_loop", "calls", f"{starts(C, 'crypto.pbkdf2Sync', 'crypto.scryptSync', 'zlib.gzipSync', 'fs.readFileSync', 'bcrypt.hashSync')} or ({eq(C, 'JSON.parse', 'JSON.stringify')} and {flag('in_loop')})", f"case when {flag('in_loop')} then 'High' else 'Medium' end", "Performance"),
    Rule("typescript.empty_catch", "marks", kind("empty_catch"), "'High'", "Correctness"),
    Rule("typescript.express.missing_error_middleware", "marks", kind("app"), "'High'", imports=("express",), no_marks="x.kind = 'middleware' and position('rror' in x.name) > 0"),
    Rule("typescript.global_mutable_state", "marks", kind("global") + f" and {eq(N, 'let', 'var')} and {starts(T, '[', '{', 'new ')}"),
    Rule("typescript.grpc_no_deadline", "calls", f"{starts(C, 'client.', 'stub.')} and not {has(A, 'deadline', 'timeout')}", imports=("grpc",)),
    Rule("typescript.http.missing_retry", "marks", kind("http_call"), "'Low'", no_imports=("retry", "got", "ky")),
    Rule("typescript.http_missing_timeout", "marks", kind("http_call") + " and " + lacks("timeout"), "'High'", imports=SERVER),
    Rule("typescript.large_response_memory", "calls", ends(C, ".json", ".text", ".buffer", ".arraybuffer"), "'Low'"),
    Rule("typescript.missing_circuit_breaker", "marks", kind("http_call") + f" and not {has(T, 'localhost', '127.0.0.1')}", no_imports=("opossum", "cockatiel", "circuit-breaker", "brakes")),
    Rule("typescript.missing_correlation_id", "marks", kind("http_call"), "'Low'", imports=SERVER, no_imports=("correlation", "cls-hooked")),
    Rule("typescript.missing_graceful_shutdown", "files", "true", imports=("express", "fastify", "@nestjs"), no_calls="x.callee = 'process.on' and (position('SIGTERM' in x.args) > 0 or position('SIGINT' in x.args) > 0)"),
    Rule("typescript.missing_idempotency_key", "marks", kind("http_call") + f" and {eq(N, 'POST', 'PUT', 'PATCH')} and not {has(f'lower({T})', 'idempoten')}", "'Low'", "Correctness"),
    Rule("typescript.missing_null_check", "marks", kind("param") + f" and {flag('optional')} and {lacks('default')} and {flag('dereferenced')}", dimension="Correctness"),
    Rule("typescript.missing_rate_limiting", "files", "true", imports=("express", "fastify", "@nestjs"), no_imports=("rate-limit", "limiter", "throttler")),
    Rule("typescript.missing_structured_logging", "calls", starts(C, "console.") + " and " + lacks("test"), "'Low'", imports=SERVER, no_imports=("winston", "pino", "bunyan", "log4js", "loglevel")),
    Rule("typescript.missing_tracing", "files", "true", "'Low'", imports=SERVER, no_imports=("opentelemetry", "jaeger", "zipkin", "datadog", "newrelic")),
    Rule("typescript.n_plus_one_queries", "calls", flag("in_loop") + " and " + has(C, "findOne", "findUnique", "findById", ".find", ".query", "$queryRaw"), "'High'", "Performance", imports=ORM),
    Rule("typescript.naive_datetime", "calls", f"{eq(C, 'Date', 'new Date')} and not {has(A, 'Z', 'T', 'ISO')}", "'Low'", "Correctness", no_imports=("date-fns", "luxon", "dayjs", "moment")),
    Rule("typescript.nextjs.api_missing_error_logging", "marks", kind("function") + f" and {eq(N, 'GET', 'POST', 'PUT', 'PATCH', 'DELETE', 'default')} and {flag('try_catch')}", imports=("next",), no_calls=has("x.callee", "console.error", "logger.error", "log.error")),
    Rule("typescript.promise_no_catch", "calls", f"{lacks('awaited')} and {lacks('in_loop')} and not {ends(C, '.then', '.catch', '.finally')} and ({eq(C, 'fetch')} or {starts(C, 'axios.', 'http.', 'https.', 'got.', 'ky.')} or {ends(f'lower({C})', '.save', '.create', '.findone', '.findmany', '.update', '.delete', '.execute')})", "'High'"),
    Rule("typescript.race_condition", "marks", kind("function") + f" and {flag('async')} and {flag('writes_global')}", "'High'", "Correctness", marks="x.kind = 'global'"),
    Rule("typescript.regex_compile", "calls", f"{eq(C, 'RegExp', 'new RegExp')} and r.fn is not null", "'Low'", "Performance"),
    Rule("typescript.sql_injection", "calls", f"{ends(C, 'query', 'execute', 'raw', 'sql')} and {has(f'upper({A})', 'SELECT ', 'INSERT ', 'UPDATE ', 'DELETE ')} and {has(A, '+', '${', 'req.', 'params.', 'body.')}", "'Critical'", "Security"),
    Rule("typescript.sync_dns_lookup", "calls", ends(C, "lookupSync", "resolveSync", "dns.lookup"), imports=("dns",)),
    Rule("typescript.transaction_boundary", "marks", kind("function") + f" and {has(f'lower({N})', 'transfer', 'exchange', 'batch', 'bulk', 'multi', 'sync', 'migrate', 'process', 'import')}", dimension="Correctness", imports=ORM),
    Rule("typescript.unbounded_cache", "marks", kind("variable") + f" and ({has(f'lower({N})', 'cache', 'memo')} or {starts(T, 'new Map()')})", no_imports=("lru", "ttl"), no_calls=ends("x.callee", ".delete", ".clear")),
    Rule("typescript.unbounded_concurrency", "calls", f"{eq(C, 'Promise.all', 'Promise.allSettled')} and {has(A, '.map(')} and not {has(A, 'limit')}", "'High'", no_imports=("p-limit",)),
    Rule("typescript.unbounded_memory", "calls", flag("in_loop") + " and " + ends(C, ".push", ".concat", ".slice", "Array.from", ".fill")),
    Rule("typescript.unbounded_retry", "calls", f"({has(f'lower({C})', 'retry', 'attempt')} or ({flag('in_loop')} and {has(C, 'fetch', 'axios', '.query')})) and not {has(A, 'maxRetries', 'attempts', 'limit', 'backoff')}"),
    Rule("typescript.unsafe_any", "marks", kind("param", "variable") + f" and {has(T, 'any')} and not {has(T, 'unknown')}", "'Low'", "Correctness"),
    Rule("typescript.unsafe_eval", "calls", f"{eq(C, 'eval', 'Function', 'new Function')} or ({eq(C, 'setTimeout', 'setInterval')} and {starts(A, chr(34), chr(39))})", "'High'", "Security"),
]
