"""op10 counts every trusted document, however many there are."""

from tessera.llm import quality_llr


def test_no_cap_on_trusted_ids(spark):
    docs = spark.range(30_000).selectExpr("id", "concat('w', id % 97, ' x') as text")
    # all are trusted, so both shares of each bin are equal
    assert set(quality_llr.log_ratios(docs, docs.select("id"), buckets=256)) == {0.0}


def test_texts_do_not_move(spark):
    """Whatever size Spark broadcasts by itself, and of ids of any kind, few or many."""
    from pyspark.sql import functions as F

    at, old = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    docs = spark.range(-9_000, 9_000).selectExpr("if(id % 50 = 0, null, id * 37) as id", "concat('w', id % 97, ' x') as text").union(spark.sql("select id, 'min' from values (-9223372036854775808L), (9223372036854775807L), (null) as t(id)"))
    docs = docs.union(docs.limit(40))  # ids repeat
    trusted = docs.filter("id % 3 = 0 or id is null or abs(cast(id as double)) > 1e18").select("id").union(spark.range(7, 9))
    want = sorted((r["id"], 1) for r in docs.filter("id % 3 = 0 or abs(cast(id as double)) > 1e18").select("id").collect())
    try:
        spark.conf.set(at, "-1")
        for kind in ("long", "int", "string"):
            d, t = (x.withColumn("id", F.expr(f"try_cast(id as {kind})")) for x in (docs, trusted))
            got = quality_llr.marked(d, t)
            plan = got._jdf.queryExecution().optimizedPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
            moved = quality_llr.marked(d, t, most=5)
            assert "SortMergeJoin" in moved._jdf.queryExecution().executedPlan().toString()
            for x in (got, moved):
                assert x.count() == docs.count() and set(x.columns) == {"id", "text", "good"}
                assert sorted((int(r["id"]), r["good"]) for r in x.filter("good is not null").collect()) == [w for w in want if kind != "int" or abs(w[0]) < 1 << 31]
    finally:
        spark.conf.set(at, old)
