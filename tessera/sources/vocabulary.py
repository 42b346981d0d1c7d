"""Words of the projected fact tables: per language, what calls, marks and imports look like in source code."""

from __future__ import annotations

#: (callee, args, flags)
CALLS = {
    "python": (
        ("requests.get", "url, timeout=5", ",in_loop,"), ("asyncio.create_task", "work()", ""), ("datetime.now", "", ""), ("session.execute", "f\"SELECT * FROM t WHERE id = {x}\"", ",in_loop,"),
        ("eval", "expr", ""), ("yaml.load", "text", ""), ("re.compile", "pattern", ""), ("open", "path, \"w\"", ",in_loop,"), ("print", "x", ""), ("logger.info", "x", ""), ("redis.set", "key, value", ""),
        ("create_engine", "dsn", ""), ("json.loads", "body", ",in_async,"), ("asyncio.gather", "*tasks", ""), ("subprocess.run", "cmd, shell=True", ""), ("User.objects.filter", "active=True", ",in_loop,"),
        ("lru_cache", "maxsize=None", ""), ("httpx.AsyncClient", "", ""), ("pd.read_csv", "path", ""), ("socket.getaddrinfo", "host, 80", ",in_async,"), ("stub.Get", "request", ""), ("session.add", "row", ""), ("increment", "counter", ""), ("helpers.run", "x", ""),
    ),
    "go": (
        ("http.Get", "url", ",in_loop,"), ("panic", "err", ""), ("append", "xs, x", ",in_loop,"), ("make", "map[string]int", ",in_loop,"), ("db.Query", "\"SELECT * FROM t WHERE id=\" + id", ""), ("regexp.MustCompile", "p", ",in_loop,"),
        ("gorm.Open", "dsn", ""), ("db.Find", "&rows", ",in_loop,"), ("c.Query", "\"q\"", ""), ("c.ShouldBindJSON", "&v", ""), ("fmt.Println", "x", ""), ("http.ListenAndServe", "addr, nil", ""), ("ioutil.ReadAll", "r", ""), ("net.LookupHost", "h", ""),
        ("rdb.Set", "k, v, 0", ""), ("rdb.HSet", "k, v", ""), ("template.HTML", "s", ""), ("tx.Begin", "", ""), ("reflect.TypeOf", "x", ",in_loop,"), ("os.Create", "\"/tmp/x\"", ""), ("errors.New", "err.(T)", ""), ("json.Marshal", "rows", ""), ("c.Bind", "&v", ""), ("run", "x", ""),
    ),
    "rust": (
        ("std::fs::read", "p", ",in_async,"), ("x.clone", "", ",in_loop,"), ("Regex::new", "p", ""), ("sqlx::query", "\"UPDATE t\"", ",in_loop,"), ("pool.execute", "q", ""), ("Router::new", "", ""), ("NaiveDateTime::parse", "s", ""), ("reqwest::get", "u", ",in_loop,"),
        ("unbounded_channel", "", ""), ("r.read_to_end", "buf", ",in_loop,"), ("axum::serve", "l", ""), ("PgPoolOptions::new", "", ""), ("serde_json::to_vec", "v", ",in_async,"), ("resp.json", "", ""), ("user_client.get", "r", ""), ("lookup_host", "h", ",in_async,"),
        ("File::create", "\"/tmp/x\"", ""), ("fn_1", "n", ""), ("iter.collect", "", ""), ("tokio::spawn", "f", ""), ("hash", "x", ""), ("bcrypt::hash", "p", ",in_async,"), ("thread::sleep", "d", ",in_async,"), ("run", "x", ""),
    ),
    "typescript": (
        ("fetch", "url", ""), ("axios.get", "url", ",in_loop,"), ("console.log", "x", ""), ("JSON.parse", "s", ",in_loop,"), ("eval", "s", ""), ("setTimeout", "\"f()\", 5", ""), ("db.query", "\"SELECT * FROM t WHERE id=\" + req.id", ""), ("repo.findOne", "id", ",in_loop,"),
        ("new RegExp", "p", ""), ("Promise.all", "xs.map(f)", ""), ("xs.push", "x", ",in_loop,"), ("new Date", "s", ""), ("dns.lookup", "h", ""), ("retryCall", "f", ""), ("res.json", "", ""), ("client.call", "r", ""), ("crypto.pbkdf2Sync", "p", ",in_loop,"), ("user.save", "", ""),
        ("process.on", "\"exit\"", ""), ("fs.readFileSync", "p", ""), ("logger.info", "x", ""), ("cache.delete", "k", ""), ("app.use", "f", ",awaited,"), ("run", "x", ",awaited,"),
    ),
}
#: (kind, name, text, flags)
MARKS = {
    "python": (
        ("bare_except", "", "except:", ""), ("http_call", "GET", "requests.get(url)", ",in_async,"), ("http_call", "POST", "httpx.post(url)", ",timeout,retry,"), ("orm_query", "User", "session.query(User)", ",in_loop,"), ("orm_query", "Item", "select(Item)", ",in_comprehension,eager,"), ("app", "app", "FastAPI()", ""),
        ("assignment", "CACHE", "{}", ",module_level,"), ("assignment", "state", "[]", ",module_level,"), ("assignment", "ALLOWED_HOSTS", "['*']", ",module_level,"), ("assignment", "SESSION_COOKIE_SECURE", "False", ",module_level,"), ("assignment", "SECURE_HSTS_SECONDS", "0", ",module_level,"), ("assignment", "email", "email: str", ""),
        ("route", "POST", "/items", ",untyped_body,raw_body,"), ("route", "GET", "/items", ""), ("middleware", "cors", "CORSMiddleware", ""), ("function", "shutdown", "def shutdown()", ""),
    ),
    "go": (
        ("goroutine", "", "go func() { m[k] = v }()", ",anonymous,in_loop,"), ("goroutine", "", "go work(ctx)", ",context,recover,"), ("defer", "", "defer f.Close()", ",in_loop,"), ("defer", "", "defer func() { recover() }()", ""), ("channel_send", "", "c <- 1", ""), ("context", "", "context.Background()", ",in_handler,"),
        ("context", "", "context.WithCancel(c)", ""), ("mutex", "mu", "mu.Lock()", ",empty,"), ("mutex", "mu", "mu.Lock()", ""), ("unchecked_error", "", "f()", ""), ("http_call", "GET", "http.Get(u)", ""), ("declaration", "cache", "map[string]int", ""), ("declaration", "items", "[]int", ",const,"),
        ("function", "CreateOrder", "(w http.ResponseWriter)", ",handler,"), ("function", "FirstItems", "([]int)", ",returns_slice,"), ("channel_close", "", "close(c)", ""),
    ),
    "rust": (
        ("unwrap", "", "x.unwrap()", ""), ("unwrap", "", "x.unwrap()", ",test,"), ("unsafe", "", "unsafe { *p }", ",one_op,"), ("unsafe", "", "unsafe { f() }", ",two_ops,"), ("spawn", "", "tokio::spawn", ""), ("spawn", "", "tokio::spawn", ",captured,"), ("macro", "println", "x", ""), ("macro", "panic", "x", ""),
        ("macro", "format", "SELECT * FROM t WHERE a = {}", ""), ("macro", "loop", "f().await", ""), ("macro", "log::info", "x {}", ""), ("static", "CACHE", "HashMap<K, V>", ""), ("result_ignore", "", "let _ = f()", ""), ("select", "", "select!", ""), ("function", "post_item", "()", ",async,pub,unwraps,"), ("await", "", "client.get(u).await", ""),
    ),
    "typescript": (
        ("function", "load", "async load()", ",async,"), ("function", "GET", "async GET()", ",async,try_catch,"), ("function", "bulkImport", "()", ",writes_global,async,"), ("bare_catch", "", "catch {", ""), ("empty_catch", "", "catch (e) {}", ""), ("http_call", "POST", "axios.post(u)", ""), ("http_call", "GET", "fetch(u)", ",timeout,"), ("app", "app", "express()", ""),
        ("global", "let", "[]", ""), ("variable", "cacheMap", "new Map()", ""), ("param", "x", "any", ",optional,dereferenced,"), ("param", "y", "unknown", ""), ("middleware", "errorHandler", "app.use(errorHandler)", ""), ("variable", "total", "number", ""), ("route", "GET", "/x", ""), ("function", "plain", "()", ""),
    ),
}
IMPORTS = {
    "python": ("asyncio", "sqlalchemy", "fastapi", "django.db", "flask", "requests", "structlog.testing", "redis", "socket", "threading", "signal", "grpc", "pydantic", "circuitbreaker", "os", "json"),
    "go": ("net/http", "gorm.io/gorm", "github.com/labstack/echo", "github.com/go-redis/redis", "google.golang.org/grpc", "reflect", "go.uber.org/zap", "golang.org/x/sync/errgroup", "os", "fmt", "net", "database/sql", "github.com/sony/gobreaker", "go.opentelemetry.io/otel", "context", "sync"),
    "rust": ("axum", "tokio", "sqlx", "reqwest", "tracing", "tonic", "std::fs", "serde", "moka", "actix_web", "std::sync", "failsafe", "hyper", "chrono", "regex", "anyhow"),
    "typescript": ("express", "fastify", "prisma", "typeorm", "axios", "winston", "opossum", "next", "dns", "grpc", "p-limit", "lru-cache", "fs", "http", "rate-limit", "opentelemetry"),
}


def _literal(x) -> str:
    return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def values(words: dict[str, tuple]) -> str:
    """A VALUES list of (language, number, word...)."""
    rows = [(lang, k, *(w if isinstance(w, tuple) else (w,))) for lang, ws in words.items() for k, w in enumerate(ws)]
    return "(values " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + ")"
