"""The pipeline on the smallest tables, stage by stage against brute force."""

import hashlib
import os
from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm import mixing, quality_knn
from tessera.llm.common import stage, table
from tests.llm.test_documents import library
from tests.llm.test_near_copies import brute_kept

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_and_run(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    model = quality_knn.fit(docs, table(spark, SF, "labels"))
    rows = sorted((tuple(r) for r in docs.collect()), key=lambda r: r[0])
    scores = model.scores([r[1] for r in rows])
    want = [r for r, s in zip(rows, scores) if s >= quality_knn.THRESHOLD]
    steps = dict(corpus_pipeline.STAGES)

    got = stage(steps["quality classifier"](spark, docs, SF), "t")
    assert got.columns == columns and sorted(map(tuple, got.collect())) == want and len(want) < len(rows)

    last = {r[1]: r[0] for r in want}
    want = [r for r in want if last[r[1]] == r[0]]
    got = stage(steps["exact dedup"](spark, got, SF), "t")
    assert got.columns == columns and sorted(map(tuple, got.collect())) == want

    stays, n_links = brute_kept([(r[0], r[1]) for r in want])
    want = [r for r in want if r[0] in stays]
    got = stage(steps["simhash near-dedup"](spark, got, SF), "t")
    assert got.columns == columns and sorted(map(tuple, got.collect())) == want

    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(got).collect()}
    mixed = stage(steps["mixing"](spark, got, SF), "t")
    want = sorted(r for r in want for _ in range(copies[r[0]]))
    assert mixed.columns == columns and sorted(map(tuple, mixed.collect())) == want

    lib = library()
    coded = Counter()
    for r in want:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        coded[r[0], len(ids), tuple(ids), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    as_rows = lambda df: Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded_sha256"]) for r in df.collect())
    assert as_rows(steps["bpe"](spark, mixed, SF)) == coded
    assert as_rows(corpus_pipeline.run(spark, SF)) == coded


def test_last_stage_alone_changes_columns(spark):
    empty = table(spark, SF, "documents").limit(0)
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, empty, SF)
        assert out.columns == empty.columns and out.count() == 0, name
