"""The pipeline's near-dedup against brute force over all pairs."""

import os
import random

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import near_copies
from tessera.llm.common import table

SF = "/root/testdata/sf0.001"


def brute_kept(rows):
    """Ids that stay of (id, text), by the Jaccard similarity of all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    n_links = 0
    for b in range(len(rows)):
        for a in range(b):
            if sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                n_links += 1
                root[find(b)] = find(a)
    best = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            best[find(k)] = min(i, best.get(find(k), i))
    return sorted(best.values()), n_links


def test_chain_of_edits(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.choice((6, 60, 200)))]
        for _ in range(8):  # each an edit of the one before: the ends of a chain are unlike
            rows.append((n, " ".join(base)))
            n += 1
            base[rng.randrange(len(base))] = word()
    rows += [(n, ""), (n + 1, None), (n + 2, "  "), (n + 3, "One"), (n + 4, "one"), (None, rows[0][1])]
    rng.shuffle(rows)
    want, n_links = brute_kept(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()]
    assert sorted(i for i in got if i is not None) == want and got.count(None) == 1
    assert n_links > 20 and len(want) < len(rows) - 20


def test_large_groups_common_lines_and_small_parts(spark):
    """Common shingles, shards joined whole, groups cut into parts with members left apart, repeated rows."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    base, line, rows = [word() for _ in range(60)], [word() for _ in range(12)], []
    for n in range(150):
        edited = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 2, 3, 6))):
            edited[rng.randrange(60)] = word()
        rows.append((n, " ".join(edited)))
    rows += [(200 + n, " ".join([word() for _ in range(rng.choice((1, 20, 70)))] + line)) for n in range(80)]
    rows += [rows[3], rows[3], (None, rows[200][1] + " end")]
    rng.shuffle(rows)
    want, n_links = brute_kept(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert n_links > 1000 and 20 < len(want) < 200
    hows = [{}, {"common": 3, "part": 16}, {"common": 3, "shard_rows": 10, "part": 7}, {"common": 1000, "part": 1000}]
    for how in [*hows, {"common": 3, "part": 16, "few": 0}, {"common": 3, "shard_rows": 10, "part": 7, "few": 60}]:  # nothing or some broadcast
        got = [r["doc_id"] for r in near_copies.keep_one(docs, **how).collect()]
        assert sorted({i for i in got if i is not None}) == want and len(got) - len(set(got)) == (2 if 3 in want else 0), how


def test_radius_covers_the_similar(spark):
    """Of pairs at the least similarity, the share whose fingerprints are within the radius."""
    rng = random.Random(9)
    found = n = 0
    for _ in range(3000):
        size = rng.choice((9, 18, 45, 90, 450))
        shared = rng.sample(range(1 << 62), size)
        both = size * 8 // 9  # of two sets of this size with as many of their own, or one within the other
        a, b = shared, shared[:both] + rng.sample(range(1 << 62), size - both) if rng.random() < 0.5 else shared[: -(-size * 8 // 10)]
        fa, fb = (near_copies.simhash(np.sort(near_copies.mix(np.array(x, "u8"), 1)).view("i8"), (0, 1, 2, 3)) for x in (a, b))
        far = np.bitwise_count((fa ^ fb).view("u8")).astype(int)
        n += 1
        found += far[0] <= near_copies.RADIUS and bool(near_copies._fits([np.array([len(a)])] + list(fa.reshape(4, 1)), [np.array([len(b)])] + list(fb.reshape(4, 1)))[0])
    assert found / n > 0.999


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_documents(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    want, _ = brute_kept([tuple(r) for r in docs.collect()])
    got = sorted({r["doc_id"] for r in near_copies.keep_one(docs).collect()})
    assert got == want
