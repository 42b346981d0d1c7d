"""Discovery, Python facts, readers and the streaming aggregate."""

import json

from pyspark.sql import functions as F

from tessera.operators import rules
from tessera.sources import files, python_facts
from tessera.streaming.spans import remote_windows

APP = '''
import requests
from fastapi import FastAPI
app = FastAPI()

@app.get("/items")
async def items():
    for u in urls:
        requests.get(u)
    try:
        eval("1")
    except:
        pass
'''


def test_discovery_numbers_files_by_path(spark, tmp_path):
    for name in ("src/b.py", "src/a.py", "src/a.txt", "src/test_a.py", "lib/c.go", "node_modules/x.js"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("import fastapi\n")
    got = files.discover(spark, str(tmp_path))
    assert sorted(map(tuple, got.select("file_id", "path", "language").collect())) == [(0, "lib/c.go", "go"), (1, "src/a.py", "python"), (2, "src/b.py", "python")]
    assert [tuple(r) for r in files.frameworks(got).collect()] == [("fastapi", 3)]
    assert files.discover(spark, str(tmp_path), keep_tests=True).count() == 4
    stored = got.filter("file_id < 2").withColumn("content_hash", F.xxhash64("content"))
    assert [r["path"] for r in files.new_files(got, stored).collect()] == ["src/b.py"]


def test_rules_on_real_sources(spark):
    src = spark.createDataFrame([(1, "app.py", "python", APP), (2, "bad.py", "python", "def ("), (3, "n.py", "python", None)], "file_id long, path string, language string, content string")
    found = rules.evaluate(python_facts.tables(src, python_facts.extract(src)))
    got = {(r["rule_id"], r["line"]) for r in found.collect() if r["file_id"] == 1}
    assert {("python.bare_except", 12), ("python.unsafe_eval", 11), ("python.http.missing_timeout", 9), ("python.http.blocking_in_async", 9), ("python.io_in_hot_path", 9), ("fastapi.missing_cors", 4)} <= got
    assert found.filter("file_id = 2").count() == 0


def test_objectives_and_traces(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "1", "name": "n", "tags": ["path:/api/x", "method:get"]}))
    (tmp_path / "b.json").write_text(json.dumps({"id": "2", "name": "checkout /api/pay/* ok", "description": None}))
    got = files.read_slos(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"))
    assert sorted((r["slo_id"], r["path_pattern"], r["http_method"]) for r in got.collect()) == [("1", "/api/x", "GET"), ("2", "/api/pay/*", None)]
    span = {"spanId": "s", "parentSpanId": None, "kind": "RPC_CLIENT", "name": "GET /x", "startTime": "2024-01-01T00:00:00Z", "endTime": "2024-01-01T00:00:00.250Z", "labels": {"http.url": "http://pay.shop.svc.cluster.local/x"}}
    (tmp_path / "t.json").write_text(json.dumps({"traceId": "t", "spans": [span, {**span, "endTime": "2023-01-01T00:00:00Z", "labels": {"peer.service": "p"}}]}))
    rows = files.read_traces(spark, str(tmp_path / "t.json")).collect()
    assert [(r["service"], r["latency_ms"]) for r in rows] == [("pay", 250), ("p", None)]
    f = spark.createDataFrame([("r", "a.py", 3, "High")], "rule_id string, path string, line int, severity string")
    assert json.loads(files.sarif(f).first()["value"])["level"] == "error"


def test_stream_agrees_with_batch(spark, tmp_path):
    spans = spark.sql("select timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) as start_time, if(id % 2 = 0, 'CLIENT', 'SERVER') as kind, concat('s', id % 3) as service, cast(id as double) as latency_ms from range(60)")
    spans.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spans.schema).parquet(str(tmp_path / "in"))
    q = remote_windows(stream, "10 minutes").writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = set(map(tuple, remote_windows(spans, "10 minutes").collect()))
    closed = set(map(tuple, spark.table("windows").collect()))
    assert closed and closed <= batch
