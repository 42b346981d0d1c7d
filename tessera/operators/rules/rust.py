"""Rules for Rust facts."""

from .engine import Rule, ends, eq, flag, has, kind, lacks, lines_near, starts

C, A, N, T = "r.callee", "r.args", "r.name", "r.text"
FN = kind("function") + " and " + lacks("test")
ASYNC_FN = FN + " and " + flag("async")
WEB = ("axum", "actix", "warp", "rocket", "poem", "tide")
BLOCKING = ("std::fs::", "std::thread::sleep", "std::io::stdin", "std::net::Tcp", "std::process::Command")
IO = ("std::fs::", "File::open", "File::create", "reqwest::", "TcpStream::connect")
RULES = [
    Rule("rust.arc_mutex_contention", "marks", kind("param", "static") + f" and {has(T, 'Arc<Mutex<')} and not {has(T, 'tokio', 'parking_lot', 'async_std')}", f"case when {flag('async')} then 'High' else 'Medium' end", "Performance"),
    Rule("rust.axum.missing_cors", "calls", f"{has(C, 'Router::new', 'Router::with_state')}", imports=("axum",), no_calls=has("x.callee", "CorsLayer")),
    Rule("rust.axum.missing_error_handler", "marks", ASYNC_FN + f" and not {has(T, 'Result')} and {flag('unwraps')}", "'High'", imports=("axum",)),
    Rule("rust.axum.missing_timeout", "calls", has(C, "Router::new"), imports=("axum",), no_calls=has("x.callee", "TimeoutLayer", "tower::timeout")),
    Rule("rust.blocking_in_async", "calls", flag("in_async") + " and " + has(C, *BLOCKING, "thread::sleep"), "'High'", "Performance"),
    Rule("rust.clone_in_loop", "calls", flag("in_loop") + f" and {ends(C, '.clone')} and {lacks('test')}", dimension="Performance"),
    Rule("rust.cpu_in_async", "calls", flag("in_async") + f" and {has(C, 'bcrypt::', 'argon2::', 'serde_json::to_', 'flate2::', 'image::', 'sha2::')} and not {has(A, 'spawn_blocking', 'rayon')}", dimension="Performance"),
    Rule("rust.ephemeral_filesystem_write", "calls", f"{has(C, 'fs::write', 'File::create', 'fs::create_dir')} and {has(A, '/tmp', 'temp')} and {lacks('test')}"),
    Rule("rust.global_mutable_state", "marks", kind("static") + f" and ({flag('mut')} or ({has(T, 'Vec<', 'HashMap<', 'HashSet<')} and not {has(T, 'Mutex', 'RwLock', 'Atomic')}))", "'High'"),
    Rule("rust.grpc_no_deadline", "calls", has(C, "_client", "Client::", "_rpc"), "'High'", imports=("tonic", "grpc"), no_calls=has("x.callee", "timeout", "deadline")),
    Rule("rust.ignored_result", "marks", kind("result_ignore") + f" and {lacks('test')} and not {has('coalesce(r.fn, ' + chr(39) * 2 + ')', 'shutdown', 'signal')}"),
    Rule("rust.io_in_hot_path", "calls", flag("in_loop") + " and " + has(C, *IO), "'High'", "Performance"),
    Rule("rust.large_response_memory", "calls", ends(C, ".bytes", ".text", ".json", "to_vec", "read_to_string", "read_to_end"), imports=("reqwest", "hyper", "surf")),
    Rule("rust.missing_async_timeout", "marks", kind("await") + f" and {has(T, '.send(', 'connect(', '.get(', '.query(')} and not {has(T, 'timeout')}", no_calls=ends("x.callee", "Client::builder.timeout")),
    Rule("rust.missing_circuit_breaker", "calls", has(C, "reqwest::", ".send"), no_imports=("failsafe", "circuit_breaker", "recloser"), at_least=2),
    Rule("rust.missing_correlation_id", "marks", ASYNC_FN + f" and {has(N, 'handler', 'handle_')}", imports=WEB, no_calls=has("x.args", "correlation", "request_id", "trace_id")),
    Rule("rust.missing_idempotency_key", "marks", ASYNC_FN + f" and ({starts(N, 'post_', 'put_', 'create_', 'update_', 'delete_')} or {ends(N, '_submit', '_process')})", dimension="Correctness", imports=("axum", "actix", "warp"), no_calls=has("x.args", "idempot")),
    Rule("rust.missing_select_timeout", "marks", kind("select") + f" and {lacks('timeout')} and {lacks('default')} and not {has('coalesce(r.fn, ' + chr(39) * 2 + ')', 'shutdown', 'signal')}"),
    Rule("rust.missing_structured_logging", "marks", kind("macro") + f" and {starts(N, 'log::')}", "'Low'", imports=("tracing",)),
    Rule("rust.missing_tracing", "marks", FN + f" and {flag('pub')} and {lacks('instrument')} and {N} <> 'main'", "'Low'", imports=("tracing",)),
    Rule("rust.n_plus_one", "calls", flag("in_loop") + f" and {has(C, 'sqlx::query', '.fetch_one', '.fetch_all', 'diesel::', '.find_by')} and not {has(C, 'batch')}", "'High'", "Performance"),
    Rule("rust.naive_datetime", "calls", has(C, "NaiveDateTime", "NaiveDate", "NaiveTime"), dimension="Correctness"),
    Rule("rust.panic_in_library", "marks", kind("macro") + f" and {eq(N, 'panic', 'todo', 'unimplemented', 'unreachable')} and {lacks('test')} and coalesce(r.fn, '') <> 'main'", f"case when {eq(N, 'unreachable')} then 'Medium' else 'High' end"),
    Rule("rust.println_in_lib", "marks", kind("macro") + f" and {eq(N, 'println', 'eprintln', 'dbg', 'print')} and {lacks('test')} and coalesce(r.fn, '') <> 'main'", f"case when {eq(N, 'dbg')} then 'High' else 'Medium' end"),
    Rule("rust.regex_compile", "calls", ends(C, "Regex::new") + f" and {lacks('test')} and {lacks('static')} and coalesce(r.fn, '') <> 'main'", dimension="Performance"),
    Rule("rust.spawn_no_error_handling", "marks", kind("spawn") + " and " + lacks("captured")),
    Rule("rust.sql_injection", "marks", kind("macro") + f" and {eq(N, 'format')} and {has(f'upper({T})', 'SELECT ', 'INSERT ', 'UPDATE ', 'DELETE ')} and {has(T, '{}', '{:')} and not {has(T, '$1')}", "'Critical'", "Security"),
    Rule("rust.sqlx.missing_pool_timeout", "calls", has(C, "PgPoolOptions::new", "PoolOptions::new", "Pool::connect") + " and " + lines_near("position('acquire_timeout' in n.callee) > 0", 10), imports=("sqlx",)),
    Rule("rust.sqlx.missing_transaction", "calls", f"{ends(C, '.execute')} or {has(f'upper({A})', 'INSERT ', 'UPDATE ', 'DELETE ')}", "'High'", "Correctness", imports=("sqlx",), no_calls=has("x.callee", "begin", "transaction"), at_least=2, per="fn"),
    Rule("rust.sqlx.query_without_timeout", "calls", has(C, "sqlx::query", ".fetch_", ".execute"), imports=("sqlx",), no_calls=has("x.callee", "tokio::time::timeout")),
    Rule("rust.sync_dns_lookup", "calls", flag("in_async") + " and " + has(C, "to_socket_addrs", "lookup_host"), "'High'", "Performance", no_calls=has("x.callee", "spawn_blocking")),
    Rule("rust.tokio.missing_graceful_shutdown", "calls", has(C, "serve", "bind", "listen", ".run"), "'High'", imports=("tokio",), no_calls=has("x.callee", "signal", "ctrl_c")),
    Rule("rust.tokio.missing_runtime_config", "marks", kind("attribute") + f" and {has(T, 'tokio::main')} and not {has(T, 'flavor', 'worker_threads', 'start_paused')}", "'Low'", "Performance"),
    Rule("rust.unbounded_cache", "marks", kind("static") + f" and {has(T, 'HashMap', 'BTreeMap', 'HashSet')} and {has(f'lower({N})', 'cache', 'memo', 'store', 'registry')}", no_imports=("moka", "cached", "lru", "quick_cache")),
    Rule("rust.unbounded_channel", "calls", has(C, "unbounded_channel", "mpsc::channel", "unbounded")),
    Rule("rust.unbounded_concurrency", "marks", kind("spawn"), "'High'", no_calls=has("x.callee", "Semaphore", "buffer_unordered", "limit"), at_least=2, per="fn"),
    Rule("rust.unbounded_memory", "calls", has(C, "read_to_end", "read_to_string", ".collect") + f" and not {has(A, 'take', 'limit')}", f"case when {flag('in_loop')} then 'High' else 'Medium' end"),
    Rule("rust.unbounded_recursion", "calls", f"{C} = r.fn and {lacks('depth_param')} and {lacks('test')}", "'High'"),
    Rule("rust.unbounded_retry", "marks", kind("macro") + f" and {eq(N, 'loop')} and {has(T, '.await')}", no_imports=("backoff", "tokio_retry", "again")),
    Rule("rust.uncancelled_tasks", "marks", kind("spawn") + " and " + lacks("test"), f"case when {flag('captured')} then 'Low' else 'Medium' end", no_calls=has("x.callee", "CancellationToken", ".abort")),
    Rule("rust.unsafe_block_unaudited", "marks", kind("unsafe") + " and " + lacks("safety_comment"), f"case when {flag('two_ops')} then 'Critical' when {flag('one_op')} then 'High' else 'Medium' end", "Security"),
    Rule("rust.unsafe_unwrap", "marks", kind("unwrap") + f" and {lacks('test')} and {lacks('main')}", "'High'"),
]
