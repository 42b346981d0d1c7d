"""Rules for Go facts."""

from .engine import Rule, ends, eq, flag, has, kind, lacks, lines_near, starts

C, A, N, T = "r.callee", "r.args", "r.name", "r.text"
HANDLER = kind("function") + " and " + flag("handler")
RULES = [
    Rule("go.bare_recover", "marks", kind("defer") + f" and {has(T, 'recover()')} and not {has(T, 'log', 'slog', 'zap', 'logrus', 'fmt.Print', 'Error(', 'runtime.Stack')}", "'High'"),
    Rule("go.channel_never_closed", "marks", kind("channel_send"), "'High'", no_marks="x.kind = 'channel_close'", no_calls="x.callee = 'close'"),
    Rule("go.concurrent_map_access", "marks", kind("goroutine") + f" and {has(T, '[')} and {has(T, ']')}", "'Critical'", "Correctness", marks="x.kind = 'declaration' and position('map[' in x.text) > 0", no_marks="x.kind = 'mutex' or position('sync.Map' in x.text) > 0"),
    Rule("go.context_background_in_handler", "marks", kind("context") + f" and {has(T, 'Background', 'TODO')} and {flag('in_handler')}", f"case when {has(T, 'TODO')} then 'Medium' else 'High' end"),
    Rule("go.cpu_in_hot_path", "calls", f"{starts(C, 'bcrypt.', 'scrypt.', 'argon2.', 'pbkdf2.', 'gzip.NewWriter', 'zlib.NewWriter', 'image.Decode', 'imaging.')} or ({starts(C, 'regexp.')} and {flag('in_loop')})", f"case when {starts(C, 'image.', 'imaging.', 'regexp.')} then 'High' when {starts(C, 'gzip.', 'zlib.')} then 'Low' else 'Medium' end", "Performance"),
    Rule("go.defer_in_loop", "marks", kind("defer") + " and " + flag("in_loop"), "'High'"),
    Rule("go.echo.missing_middleware", "files", "true", "'High'", imports=("labstack/echo",), calls="x.callee = 'echo.New'", no_calls="position('Recover' in x.args) > 0"),
    Rule("go.echo.request_validation", "calls", ends(C, "Bind") + " and " + lines_near("(position('Validate' in n.callee) > 0 or position('.Struct' in n.callee) > 0)", 10), "'High'", "Correctness", imports=("labstack/echo",)),
    Rule("go.empty_critical_section", "marks", kind("mutex") + f" and ({flag('empty')} or ({lacks('defer_unlock')} and {lacks('rlock')}))", f"case when {flag('empty')} then 'High' else 'Medium' end", "Correctness"),
    Rule("go.ephemeral_filesystem_write", "calls", f"({has(C, 'os.Create', 'OpenFile', 'WriteFile')} or {ends(C, '.Write', '.WriteString')}) and ({has(A, '\"/tmp', './', '/var/', '/app/', '/data/')} or {has(C, 'Create', 'WriteFile')})", no_imports=("storage", "s3", "blob")),
    Rule("go.error_type_assertion", "calls", has(A, "err.(", "error.("), dimension="Correctness", no_calls=ends("x.callee", "errors.As")),
    Rule("go.gin.missing_validation", "calls", f"{has(C, 'ShouldBind', 'BindJSON', 'BindQuery', 'BindUri', 'BindHeader')} or {ends(C, '.Bind')}", "'Low'", "Correctness"),
    Rule("go.gin.untrusted_input", "calls", has(C, "c.Param", "c.Query", "c.PostForm", "c.GetHeader", "c.DefaultQuery", "c.GetQuery"), dimension="Security"),
    Rule("go.global_mutable_state", "marks", kind("declaration") + f" and {lacks('const')} and ({starts(T, 'map[', '[]', '*')} or {has(T, 'chan ')})", "'High'"),
    Rule("go.gorm.connection_pool", "calls", has(C, "gorm.Open"), imports=("gorm",), no_calls=has("x.callee", "SetMaxIdleConns", "SetMaxOpenConns", "SetConnMaxLifetime")),
    Rule("go.gorm.improper_session", "calls", ends(C, ".Create", ".Save", ".Update", ".Delete"), imports=("gorm",), no_calls=has("x.callee", "Begin", "Transaction", "Commit"), at_least=2),
    Rule("go.gorm.n_plus_one", "calls", flag("in_loop") + " and " + ends(C, ".Find", ".First", ".Take"), "'High'", "Performance", imports=("gorm",), no_calls=has("x.callee", "Preload", "Joins")),
    Rule("go.gorm.query_timeout", "calls", ends(C, ".Find", ".First", ".Create", ".Save", ".Update", ".Delete", ".Exec", ".Raw"), imports=("gorm",), no_calls=has("x.callee", "WithContext")),
    Rule("go.goroutine_leak", "marks", kind("goroutine") + f" and (({lacks('context')} and {lacks('done')}) or {flag('unbounded_send')})", "'High'"),
    Rule("go.grpc.missing_deadline", "calls", f"{has(C, 'Client.')} or {ends(C, 'Client')} or {has(A, 'grpc.')}", "'High'", imports=("grpc",), no_calls=has("x.callee", "WithTimeout", "WithDeadline")),
    Rule("go.http_missing_timeout", "marks", kind("http_call") + " and " + lacks("timeout"), "'High'"),
    Rule("go.http_retry", "marks", kind("http_call"), no_imports=("retryablehttp", "retry-go", "backoff", "go-retry")),
    Rule("go.idempotency_key", "marks", HANDLER + f" and {has(f'lower({N})', 'create', 'post', 'update', 'put', 'delete', 'payment', 'order', 'transfer', 'submit')} and not {has(f'lower({N})', 'get', 'list', 'fetch', 'find', 'search', 'query', 'read')}", dimension="Correctness", no_calls=has("lower(x.callee)", "idempoten")),
    Rule("go.large_response_memory", "calls", f"({ends(C, 'json.Marshal')} and {has(A, '[]', 'rows', 'results', 'items', 'all')}) or {ends(C, 'ioutil.WriteFile')}"),
    Rule("go.map_without_size_hint", "calls", f"{eq(C, 'make')} and {starts(A, 'map[')} and position(',' in {A}) = 0 and {flag('in_loop')}", "'Low'", "Performance"),
    Rule("go.missing_circuit_breaker", "marks", kind("http_call"), no_imports=("gobreaker", "hystrix-go", "rubyist/circuitbreaker")),
    Rule("go.missing_correlation_id", "files", "true", imports=("net/http",), no_calls=has("x.args", "X-Request-ID", "X-Correlation-ID", "request_id", "correlation_id")),
    Rule("go.missing_graceful_shutdown", "calls", has(C, "ListenAndServe"), no_calls=has("x.callee", "Shutdown")),
    Rule("go.missing_structured_logging", "calls", starts(C, "fmt.Print", "log.Print", "log.Fatal", "log.Panic"), "'Low'", no_imports=("zerolog", "zap", "slog", "logrus")),
    Rule("go.missing_tracing", "files", "true", marks="x.kind = 'function' and position(',handler,' in x.flags) > 0", no_imports=("otel", "opentracing")),
    Rule("go.nethttp.handler_missing_timeout", "marks", kind("function") + " and " + has(T, "ResponseWriter", "http.Request"), "'Low'"),
    Rule("go.nethttp.server_missing_timeout", "calls", f"({has(C, 'ListenAndServe')} and not {has(C, 'TLS')}) or ({has(C, 'http.Server')} and not {has(A, 'Timeout')})", f"case when {has(C, 'ListenAndServe')} then 'High' else 'Medium' end"),
    Rule("go.panic_in_library", "calls", eq(C, "panic", "log.Fatal", "log.Fatalf", "log.Fatalln", "log.Panic", "log.Panicf", "log.Panicln") + " and coalesce(r.fn, '') <> 'main'", "'High'"),
    Rule("go.race_condition", "marks", kind("goroutine") + " and " + flag("anonymous"), "'High'", "Correctness"),
    Rule("go.rate_limiting", "marks", HANDLER, no_imports=("limiter", "x/time/rate"), no_calls=has("x.callee", "rate.NewLimiter", "RateLimit")),
    Rule("go.redis.connection_pool", "calls", f"{ends(C, 'NewClient', 'NewClusterClient')} and not {has(A, 'PoolSize', 'MinIdleConns', 'MaxRetries')}", imports=("go-redis",)),
    Rule("go.redis.missing_ttl", "calls", f"({ends(C, '.Set')} and {ends(A, ', 0)', ', 0')}) or ({ends(C, '.HSet', '.MSet')} and " + lines_near("position('Expire' in n.callee) > 0", 5) + ")", "'High'", imports=("go-redis",)),
    Rule("go.reflect_in_hot_path", "calls", flag("in_loop") + " and " + starts(C, "reflect."), "'High'", "Performance", imports=("reflect",)),
    Rule("go.regex_compile", "calls", f"{eq(C, 'regexp.Compile', 'regexp.MustCompile', 'regexp.MustCompilePOSIX')} and r.fn is not null", "'Low'", "Performance"),
    Rule("go.sentinel_error_comparison", "calls", has(A, "== sql.ErrNoRows", "== io.EOF", "== os.ErrNotExist", "== context.Canceled", "== context.DeadlineExceeded"), dimension="Correctness", no_calls=ends("x.callee", "errors.Is")),
    Rule("go.slice_append_in_loop", "calls", f"{eq(C, 'append')} and {flag('in_loop')}", dimension="Performance", no_calls="x.callee = 'make' and length(x.args) - length(replace(x.args, ',', '')) >= 2"),
    Rule("go.slice_memory_leak", "marks", kind("function") + f" and {flag('returns_slice')} and {has(f'lower({N})', 'prefix', 'suffix', 'head', 'tail', 'first', 'last', 'take', 'trim')}"),
    Rule("go.sql_injection", "calls", f"{ends(C, '.Query', '.Exec', '.QueryRow', '.Raw')} and {has(A, ' + ', 'fmt.Sprintf')}", "'Critical'", "Security"),
    Rule("go.sync_dns_lookup", "calls", starts(C, "net.Lookup"), imports=("net",)),
    Rule("go.transaction_boundary", "calls", ends(C, ".Begin", ".BeginTx"), "'High'", "Correctness", no_marks="x.kind = 'defer' and position('Rollback' in x.text) > 0"),
    Rule("go.type_assertion_no_ok", "calls", f"{has(A, '.(')} and not {has(A, ', ok')}", "'High'", "Correctness"),
    Rule("go.unbounded_cache", "marks", kind("declaration") + f" and ({has(T, 'sync.Map')} or {starts(T, 'map[')}) and {has(f'lower({N})', 'cache', 'store', 'memo')}", "'High'", no_imports=("lru", "ristretto", "bigcache", "go-cache")),
    Rule("go.unbounded_goroutines", "marks", kind("goroutine") + f" and ({flag('in_loop')} or {flag('anonymous')})", "'High'", no_imports=("workerpool", "ants", "errgroup")),
    Rule("go.unbounded_memory", "calls", ends(C, "ReadAll"), "'High'", no_calls=has("x.callee", "LimitReader", "MaxBytesReader")),
    Rule("go.unbounded_retry", "calls", flag("in_loop") + f" and ({starts(C, 'http.')} or {has(C, '.Do', '.Get', '.Post', '.Execute')})", "'High'", no_imports=("retry-go", "backoff")),
    Rule("go.uncancelled_context", "marks", kind("context") + " and " + has(T, "WithCancel", "WithTimeout", "WithDeadline"), "'High'", no_marks="x.kind = 'defer' and position('cancel' in x.text) > 0"),
    Rule("go.unchecked_error", "marks", kind("unchecked_error"), dimension="Correctness"),
    Rule("go.unhandled_error_goroutine", "marks", kind("goroutine") + " and " + lacks("recover"), "'High'"),
    Rule("go.unsafe_template", "calls", f"{has(C, 'template.HTML', 'template.JS', 'template.CSS', 'template.URL')} or ({has(C, 'template.New', 'template.Must')} and {has(A, ' + ', 'Sprintf')})", "'High'", "Security"),
]
