"""SimHash near-duplicates found with BK-trees.

Texts become 64-bit fingerprints in Arrow batches. Equal fingerprints are one node, so copies cost nothing more. Two
fingerprints within ``radius`` bits agree in ``agree`` of radius + agree blocks of bits, so a fingerprint joins one shard
for each choice of that many blocks, and the shards together hold every link. The more fingerprints there are, the more
blocks a shard's key takes, so that shards stay small. In a shard the fingerprints form a BK-tree: a child hangs at its
integer Hamming distance to its parent, and a search at distance d follows only the edges d - radius to d + radius. A
shard above ``shard_rows`` is cut: each part's tree is sent to the tasks of all parts' queries; tasks read their shards
one after another, some at a time. A task doesn't return its links but a star per group that it found; the stars are
joined to components over all shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pick, stage
from .components import components

BITS, SEED = 64, 42
#: Fingerprints of one BK-tree at most.
SHARD_ROWS = 8192
#: Pairs of a query and a tree node looked at in one step; rows of whole units that a task holds at once, about.
FRONTIER, RUN_ROWS = 1 << 20, 1 << 18
#: Fingerprints of a shard by chance, at most, before its key takes another block.
BY_CHANCE = 64


def fingerprint(text: str | None, words: int = 3, seed: int = SEED) -> int:
    """Majority vote per bit over XXH64 of all word shingles of the text with A-Z lower-cased; 0 without words."""
    from xxhash import xxh64_intdigest

    toks = (text or "").encode().lower().split()  # of bytes: ASCII letters and white space only
    if not toks:
        return 0
    if len(toks) <= words:
        hashes = [xxh64_intdigest(b" ".join(toks), seed)]
    else:
        flat = b" ".join(toks)
        ends = list(accumulate(map(len, toks), lambda a, n: a + 1 + n))
        starts = [0, *(e + 1 for e in ends)]
        hashes = [xxh64_intdigest(flat[a:b], seed) for a, b in zip(starts, ends[words - 1 :])]
    votes = np.zeros(BITS, np.int64)
    h = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    for k in range(0, len(h), 1 << 16):
        votes += np.unpackbits(h[k : k + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): the unsigned fingerprint in a signed long's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.col("text").cast("string"))
    return arrow_map(rows, run, "id long, fp long")


class BKForest:
    """BK-trees of several shards at once, built and searched level by level."""

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        """fps: uint64; shard: the dense shard number of each."""
        n = len(fps)
        self.fps = fps
        self.roots = np.full(int(shard.max()) + 1 if n else 0, -1, np.int64)
        at = np.full(n, -1, np.int64)  # parent * 65 + distance; -1 at a root
        items, group = np.arange(n), shard.astype(np.int64)
        level = 0
        while len(items):
            order = np.argsort(group, kind="stable")
            items, group = items[order], group[order]
            head = np.r_[True, group[1:] != group[:-1]]
            heads = items[head]
            if level == 0:
                self.roots[group[head]] = heads
            else:
                at[heads] = group[head]
            parent = heads[np.cumsum(head) - 1][~head]
            items = items[~head]
            group = parent * 65 + np.bitwise_count(fps[items] ^ fps[parent]).astype(np.int64)
            level += 1
        order = np.argsort(at, kind="stable")
        order = order[np.searchsorted(at[order], 0) :]
        self.keys, self.children = at[order], order

    def near(self, queries: np.ndarray, shard: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query number, node) pairs within the radius, level by level."""
        q, node = np.arange(len(queries)), self.roots[shard]
        q, node = q[node >= 0], node[node >= 0]
        work = [(q, node)]
        while work:
            q, node = work.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                work += [(q[half:], node[half:]), (q[:half], node[:half])]
                continue
            d = np.bitwise_count(queries[q] ^ self.fps[node]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield q[hit], node[hit]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right")
            for part in range(0, len(q), 1 << 16):  # what a step opens stays small
                lo, n = low[part : part + (1 << 16)], (high - low)[part : part + (1 << 16)]
                if total := int(n.sum()):
                    nth = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                    work.append((np.repeat(q[part : part + (1 << 16)], n), self.children[np.repeat(lo, n) + nth]))


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label of each group after linking a[i] with b[i]; labels point to a smaller or their own place."""
    while len(a):
        a, b = label[a], label[b]
        open_ = a != b
        a, b = a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def runs(batches: Iterator[pa.RecordBatch], rows: int = RUN_ROWS) -> Iterator[pa.Table]:
    """Of rows in order of their first column, tables of whole units, about ``rows`` rows each or one longer unit."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        unit = batch.column(0).to_numpy()
        last = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on
        if last == 0 and held[0].column(0)[0].as_py() == unit[-1]:
            continue
        yield pa.Table.from_batches([*held[:-1], batch.slice(0, last)])
        held, n = [batch.slice(last)], batch.num_rows - last
    if held:
        yield pa.Table.from_batches(held)


def stars(node: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    """Links (a, b) of every node to the smallest node of its label."""
    least = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(least, label, node)
    least = least[label]
    out = node != least
    return pa.RecordBatch.from_arrays([pa.array(node[out]), pa.array(least[out])], names=["a", "b"])


def _search(radius: int, fits=None):
    """Of rows (unit, role, fp, id, ...) in order of unit: a star for each group of a unit.

    ``fits`` is asked, with the further columns of both sides, which of the pairs within the radius are links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches):
            unit, role, fp, node, *more = (rows.column(k).to_numpy() for k in range(rows.num_columns))
            order = np.lexsort((node, role, unit))
            unit, role, fp, node, more = unit[order], role[order], fp[order].view(np.uint64), node[order], [x[order] for x in more]
            unit = np.cumsum(np.r_[False, unit[1:] != unit[:-1]])
            trees, asks = np.flatnonzero(role < 2), np.flatnonzero(role != 1)  # 0: both, 1: tree, 2: query
            label = np.arange(len(fp))
            if len(trees):
                forest = BKForest(fp[trees], unit[trees])
                shard = unit[asks]
                known = shard < len(forest.roots)
                for q, hit in forest.near(fp[asks][known], shard[known], radius):
                    a, b = asks[known][q], trees[hit]
                    if fits:
                        ok = (a != b) & fits([x[a] for x in more], [x[b] for x in more])
                        a, b = a[ok], b[ok]
                    label = unite(label, a, b)
            yield stars(node, label)

    return run


def search_shards(keyed: DataFrame, radius: int, shard_rows: int = SHARD_ROWS, fits=None) -> DataFrame:
    """Links (a, b) that join what is within the radius in a shard, of rows (shard, fp, id, ...), and what ``fits``."""
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("shard_size")).filter("shard_size > 1")
    cut = keyed.join(sizes, "shard").withColumn("parts", F.ceil(F.col("shard_size") / shard_rows).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    # each unit (shard, i, j) searches the tree of part i with the queries of part j >= i
    pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = pairs.select(
        F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("role"), "fp", "id", *keyed.columns[3:],
    )
    return arrow_map(units.repartition("unit").sortWithinPartitions("unit"), _search(radius, fits), "a long, b long")


def links(nodes: DataFrame, radius: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) between ids of ``nodes`` (fp, id; each fp once) that join exactly the fingerprints within the radius."""
    n, agree = nodes.count(), 1
    while agree < 4 and n >> agree * BITS // (radius + agree) > BY_CHANCE:
        agree += 1
    cuts = [BITS * k // (radius + agree) for k in range(radius + agree + 1)]
    part = lambda k: F.shiftrightunsigned("fp", cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1))
    tables = combinations(range(radius + agree), agree)
    keyed = nodes.select("fp", "id", F.explode(F.array(*[F.xxhash64(F.lit(t), *map(part, chosen)) for t, chosen in enumerate(tables)])).alias("shard"))
    return search_shards(keyed, radius, shard_rows)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per input row: id, fingerprint (16 lowercase hex digits), component_id.

    component_id is the smallest id reachable over links of ``radius`` bits or fewer. A null or empty text has
    fingerprint zero, which links like any other. A null id takes part through its fingerprint, which may join others,
    but is never a component's id; where no other id is reachable, component_id is null. Rows that repeat share their
    component. An empty table gives no rows; other columns aren't read.
    """
    fps = stage(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = stage(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = components(stage(links(nodes.select("fp", F.col("fp").alias("id")), radius, shard_rows), "stars")).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("all"))
    shared = placed.join(of_root.filter("all > 1"), "root").select("fp", "component_id", F.lit(True).alias("shared"))
    found = fps.join(shared, "fp", "left")
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("shared"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows whose id is their component's; other rows go. Rows with a null id, which no component can name, stay."""
    stays = near_groups(docs, id_col, text_col, **how).filter(F.col("component_id") == F.col(id_col)).select(F.col(id_col).alias("__stays")).distinct()
    named = docs.join(stays, F.col(f"`{id_col}`") == F.col("__stays"), "left_semi")
    return named.unionByName(docs.filter(F.col(f"`{id_col}`").isNull()))
