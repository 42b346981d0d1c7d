"""Near copies: SimHash and BK-trees find candidates, whole sets of five-word shingles decide.

Documents with a Jaccard similarity of SHARE or more have fingerprints that differ in a sixth of their bits on average,
too many to agree in long blocks of bits. So a document's shards are named by shingles instead: put in one global order,
two sets as similar as SHARE share a shingle among the first n - ceil(SHARE * n) + 1 of each. The order is by hash, but
shingles in more than COMMON documents come last; a document that meets such ones gives as many more of its shingles,
until no document lacks uncommon ones that it has. In a shard, a BK-tree over the fingerprints finds what is within RADIUS bits, and
pairs are joined whose sizes allow the similarity and of whose 256 bits no more than WIDE differ; a pair as similar as
SHARE passes with a probability above 0.9998. Shards above ``shard_rows`` are joined whole.

What is joined over all shards is a group of candidates. Each member's set of shingles goes to a task of its group
once, or to one of several of PART members, which share some members as pivots; there all pairs are compared exactly.
Members that aren't linked to the most of their group then are compared with all of it, part by part, so no pair of a
group is left out, while a large group of copies costs work in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pick, stage, text_or_empty
from .components import components
from .simhash import RUN_ROWS, SHARD_ROWS, runs, search_shards, stars, unite
from .substring import WORD_MUL, word_hashes
from .token_files import mix

#: Words of a shingle; the least similarity in tenths, so that all comparisons are of whole numbers; of 64 bits those that a
#: search allows to differ, and of all 256.
WORDS, TENTHS, RADIUS, WIDE = 5, 8, 24, 72
#: Documents of an uncommon shingle at most; members compared in one task, pivots among them; cells of a matrix.
COMMON, PART, PIVOTS, CELLS = 128, 1024, 16, 1 << 23
#: 64-bit keys or hashes that are broadcast at most (1 MiB of them); more are joined by a shuffle.
FEW = 1 << 17


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The ascending distinct 64-bit hashes of each text's shingles with A-Z lower-cased; a short or empty text is one shingle."""
    lists = [(t or "").encode().lower().split() for t in texts]  # of bytes: ASCII letters and white space only
    h = word_hashes(b"".join([b" ".join(x) + b" " for x in lists if x]))[0]
    n = max(0, len(h) - words + 1)
    raw = np.zeros(n, np.uint64)
    for j in range(words):
        raw = raw * np.uint64(WORD_MUL) + h[j : j + n]
    raw = mix(raw, 13).view(np.int64)
    out, at = [], 0
    for x in lists:
        if len(x) >= words:
            out.append(np.unique(raw[at : at + len(x) - words + 1]))
        else:
            short = np.full(1, len(x), np.uint64)
            for k in range(len(x)):
                short = short * np.uint64(WORD_MUL) + h[at + k]
            out.append(mix(short, 17).view(np.int64))
        at += len(x)
    return out


def simhash(grams: np.ndarray, seeds: tuple = (0,)) -> np.ndarray:
    """Majority vote per bit over a set of hashes, 64 bits for each seed."""
    out = np.empty(len(seeds), np.int64)
    for s, seed in enumerate(seeds):
        votes, b = np.zeros(64, np.int64), (mix(grams.view(np.uint64), 30 + seed) if seed else grams).view(np.uint8).reshape(-1, 8)
        for k in range(0, len(b), 1 << 16):
            votes += np.unpackbits(b[k : k + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[s] = np.packbits(votes * 2 > len(b), bitorder="little").view(np.int64)[0]
    return out


def _fits(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Of pairs with (n, w1, w2, w3, fp) each: sizes that allow the similarity, and all bits within WIDE."""
    bits = sum(np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).astype(np.int64) for x, y in zip(a[1:], b[1:]))
    return (10 * np.minimum(a[0], b[0]).astype(np.int64) >= TENTHS * np.maximum(a[0], b[0]).astype(np.int64)) & (bits <= WIDE)


def stored(n: int) -> int:
    """How many of a set's n shingles are kept at first: those that meet every set as similar as SHARE, and half as many."""
    need = n + n * -TENTHS // 10 + 1
    return min(n, need + need // 2 + 16)


def _signatures(whole: bool):
    """Of (key, text): (key, n, fp, w1, w2, w3, grams) with the first shingles in the order of their hashes, or (key, grams) with all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = shingle_sets(part.column(1).to_pylist())
                grams = pa.array(sets if whole else [x[: stored(len(x))] for x in sets], pa.list_(pa.int64()))
                if whole:
                    yield pa.RecordBatch.from_arrays([part.column(0), grams], names=["key", "grams"])
                    continue
                fps = np.array([simhash(x, (0, 1, 2, 3)) for x in sets], np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int32()), *(pa.array(np.ascontiguousarray(fps[:, k])) for k in range(4)), grams], names=["key", "n", "fp", "w1", "w2", "w3", "grams"])

    return run


def _few(longs: DataFrame, few: int = FEW) -> DataFrame:
    """``longs``, a written table of one column of 64-bit numbers, to be broadcast if it has no more than ``few`` rows."""
    return F.broadcast(longs) if longs.count() <= few else longs


SIGNATURE = "key long, n int, fp long, w1 long, w2 long, w3 long, grams array<long>"
PRINT = ["fp", "n", "w1", "w2", "w3"]


def _same(overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (10 + TENTHS) * overlap >= TENTHS * (a[:, None] + b[None, :])


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """How many shingles each set of ``a`` shares with each of ``b`` (of ``a`` if not given), by products of 0/1 matrices."""
    sets = a if b is None else a + b
    grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    fresh = np.r_[True, grams[1:] != grams[:-1]]
    column = np.cumsum(fresh) - 1
    alone = np.bincount(column) == 1
    use = ~alone[column]
    owner, column = owner[use], column[use]
    column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1 if len(column) else column
    out = np.zeros((len(a), len(a if b is None else b)), np.int64)
    step = max(1, CELLS // len(sets))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        i, j = np.searchsorted(column, (low, low + step))
        m = np.zeros((len(sets), min(step, int(column[-1]) + 1 - low)), np.float32)
        m[owner[i:j], column[i:j] - low] = 1
        left, right = m[: len(a)], m if b is None else m[len(a) :]
        out += (left @ right.T).astype(np.int64)
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (unit, role, key, grams) in order of unit: stars of the sets that are alike. Role 0: with all, 1: with those of role 2."""
    for rows in runs(batches, RUN_ROWS >> 7):
        unit, role, key = (rows.column(k).to_numpy() for k in range(3))
        grams, label = rows.column(3).combine_chunks(), np.arange(len(unit))
        flat, ends = grams.flatten().to_numpy(), np.cumsum(grams.value_lengths().to_numpy())
        sets, size = np.split(flat, ends[:-1]), np.diff(ends, prepend=0).astype(np.int64)
        heads = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        for low, high in zip(heads.tolist(), [*heads[1:].tolist(), len(unit)]):
            at = np.arange(low, high)
            a, b = (at, at) if not role[low:high].any() else (at[role[low:high] == 1], at[role[low:high] == 2])
            if len(a) and len(b):
                found = overlaps([sets[x] for x in a], None if a is b else [sets[x] for x in b])
                i, j = np.nonzero(_same(found, size[a], size[b]))
                label = unite(label, a[i], b[j])
        yield stars(key, label)


def _units(rows: DataFrame) -> DataFrame:
    return arrow_map(rows.select("unit", "role", "key", "grams").repartition("unit").sortWithinPartitions("unit"), _compare, "a long, b long")


def candidates(sig: DataFrame, whole_sets, common: int = COMMON, shard_rows: int = SHARD_ROWS, few: int = FEW) -> DataFrame:
    """(key, grp): the group of each key of ``sig`` that may have a near copy.

    ``whole_sets`` gives (key, grams), whole, of the keys of a table; only documents whose uncommon shingles are few
    among those of ``sig`` need it.
    """
    need = F.expr(f"n + cast(floor(n * -{TENTHS} / 10) as int) + 1")
    known = sig.select("key", "n", need.alias("need"), F.size("grams").alias("stored"))
    known = sig.select("key", "n", need.alias("need"), F.size("grams").alias("stored"))
    given, extended = sig.select("key", F.explode(F.slice("grams", 1, need)).alias("gram")), None
    met = lambda df: df.groupBy("gram").agg(F.count("*").alias("met")).filter("met > 1")
    counts = stage(met(given), "shared")
    while True:
        often = stage(counts.filter(F.col("met") > common).select("gram"), "often")
        hot = given.join(often, "gram", "left_semi").groupBy("key").agg(F.count("*").cast("int").alias("hot")).join(known, "key")
        hot = hot.join(extended, "key", "left").withColumn("upto", F.coalesce("upto", "need")) if extended is not None else hot.withColumn("upto", F.col("need"))
        more = F.least(F.col("need") + F.col("hot") + F.floor(F.col("hot") / 2).cast("int") + 4, F.col("n"))
        short = hot.filter("upto - hot < need and upto < n").select("key", "upto", F.when(more <= F.col("stored"), more).otherwise(F.col("n")).alias("next"), F.col("stored") >= more)
        short = stage(short.toDF("key", "from", "next", "near"), "short")
        if short.isEmpty():
            break
        span = F.explode(F.slice("grams", F.col("from") + 1, F.col("next") - F.col("from"))).alias("gram")
        near = short.filter("near")
        new = sig.join(_few(near.select("key"), few), "key", "left_semi").join(near, "key").select("key", span)
        if not (far := short.filter("not near")).isEmpty():
            new = new.unionByName(whole_sets(far).join(far, "key").select("key", span))
        new = stage(new, "more")
        given = given.unionByName(new)
        touched = stage(new.select("gram").distinct(), "touched")
        if touched.count() <= few:  # other shingles are met as often as before
            again = met(given.join(F.broadcast(touched), "gram", "left_semi"))
            counts = stage(counts.join(F.broadcast(touched), "gram", "left_anti").unionByName(again), "shared")
        else:
            counts = stage(met(given), "shared")
        now = short.select("key", F.col("next").alias("upto"))
        extended = stage(now if extended is None else extended.join(now, "key", "left_anti").unionByName(now), "extended")
    if extended is not None:  # of what these gave, the first: uncommon ones in order, then common ones
        own = given.join(extended, "key", "left_semi").join(often.withColumn("often", F.lit(True)), "gram", "left")
        ordered = own.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(False)).alias("often"), "gram"))).alias("all"))
        first = ordered.join(known, "key").select("key", F.explode(F.slice("all", 1, F.col("need"))).alias("x")).select("key", "x.gram")
        given = given.join(extended, "key", "left_anti").unionByName(first)
    meets = stage(given.join(counts.select("gram"), "gram", "left_semi"), "meets")
    nodes = sig.join(meets.select("key").distinct(), "key", "left_semi").select("key", *PRINT)
    nodes = stage(nodes.join(nodes.groupBy(*PRINT).agg(F.min("key").alias("node")), PRINT), "nodes")
    keyed = meets.join(nodes, "key").select(F.col("gram").alias("shard"), "fp", F.col("node").alias("id"), *PRINT[1:], F.col("fp").alias("w0"))
    keyed = stage(keyed.distinct(), "shards")
    big = stage(keyed.groupBy("shard").agg(F.count("*").alias("n"), F.min("id").alias("low")).filter(F.col("n") > shard_rows), "big")
    joined = search_shards(keyed.join(big, "shard", "left_anti"), RADIUS, shard_rows, _fits).unionByName(keyed.join(big, "shard").select(F.col("low").alias("a"), F.col("id").alias("b")))
    roots = components(stage(joined, "candidates")).withColumnRenamed("node", "n2")
    placed = nodes.join(roots, F.col("node") == F.col("n2"), "left").select("key", F.coalesce("root", "node").alias("grp"))
    sizes = placed.groupBy("grp").agg(F.count("*").alias("members")).filter("members > 1")
    return placed.join(sizes, "grp")


def verified(groups: DataFrame, whole_sets, part: int = PART) -> DataFrame:
    """Links (a, b) between keys, all of pairs that are alike, whose components are those of all alike pairs of a group."""
    sets = stage(whole_sets(groups.select("key")).select("key", "grams").join(groups, "key"), "sets")
    parts = F.ceil(F.col("members") / part).cast("int")
    own = F.pmod(F.xxhash64("key"), parts).cast("int")
    pivot = (parts > 1) & (F.pmod(F.xxhash64("key", F.lit(5)), F.col("members")) < PIVOTS)
    to = F.when(pivot, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))
    first = sets.select("grp", "key", "grams", F.explode(to).alias("p")).withColumn("unit", F.xxhash64("grp", "p")).withColumn("role", F.lit(0))
    found = stage(_units(first), "links")
    large = sets.filter(parts > 1)
    if large.isEmpty():
        return found
    placed = stage(large.select("grp", "key", "members").join(components(found).withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "placed")
    most = placed.groupBy("grp", "root").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("root", F.struct("n", "root")).alias("most"))
    apart = placed.join(most, "grp").filter("root <> most").select("grp", "key")
    open_ = stage(apart.groupBy("grp").agg(F.count("*").alias("asking")), "open")
    if open_.isEmpty():
        return found
    asks = F.ceil(F.col("asking") / part).cast("int")
    asking = sets.join(apart.select("key"), "key", "left_semi").join(open_, "grp")
    asking = asking.select("grp", "key", "grams", F.pmod(F.xxhash64("key", F.lit(9)), asks).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("p"), F.lit(1).alias("role"))
    asked = sets.join(open_, "grp").select("grp", "key", "grams", F.explode(F.sequence(F.lit(0), asks - 1)).alias("q"), own.alias("p"), F.lit(2).alias("role"))
    rest = asking.unionByName(asked).withColumn("unit", F.xxhash64("grp", "p", "q"))
    return found.unionByName(stage(_units(rest), "rest"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON, shard_rows: int = SHARD_ROWS, part: int = PART, few: int = FEW) -> DataFrame:
    """One row per input row: id, component_id, the smallest id reachable over pairs as similar as SHARE.

    Null texts are empty; all texts without words are alike, as are equal texts. A null id takes part but is never a
    component's id; where no other id is reachable, component_id is null. Rows that repeat share their component. An
    empty table gives no rows; other columns aren't read.
    """
    rows = pick(docs, id=id_col, text=text_col).select("id", text_or_empty("text").alias("text"))
    # a row is named by a number of its own; the table that keeps it is written once
    own = rows.select(F.monotonically_increasing_id().alias("key"), "id", F.xxhash64("text").alias("h"), "text")
    sig = arrow_map(own.select("key", "text", "id", "h"), _with_names(_signatures(False)), f"{SIGNATURE}, id {rows.schema['id'].dataType.simpleString()}, h long")
    sig = stage(sig, "signatures")

    def whole_sets(keys: DataFrame) -> DataFrame:
        wanted = stage(sig.join(_few(keys.select("key"), few), "key", "left_semi").select("key", F.col("id").alias("i"), "h"), "wanted")
        texts = rows.withColumn("h2", F.xxhash64("text"))
        if (hashes := wanted.select("h")).count() <= few:  # only the texts of these keys move
            texts = texts.join(F.broadcast(hashes), F.col("h2") == F.col("h"), "left_semi")
        found = texts.join(wanted, (F.col("h2") == F.col("h")) & F.col("id").eqNullSafe(F.col("i"))).select("key", "text")
        return arrow_map(found.dropDuplicates(["key"]), _signatures(True), "key long, grams array<long>")  # a row may repeat

    groups = stage(candidates(sig.drop("id", "h"), whole_sets, common, shard_rows, few), "groups")
    roots = components(verified(groups, whole_sets, part)).withColumnRenamed("node", "key")
    placed = sig.select("key", "id").join(roots, "key", "left").withColumn("linked", F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "key"))
    least = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    return placed.join(least, "root").select(F.col("id").alias(id_col), "component_id")


def _with_names(run):
    """``run`` over the first two columns, the others carried along."""

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for out in run(iter([pa.RecordBatch.from_arrays(batch.columns[:2], names=["key", "text"])])):
                more = batch.slice(at, out.num_rows)
                yield pa.RecordBatch.from_arrays([*out.columns, *more.columns[2:]], names=[*out.schema.names, *batch.schema.names[2:]])
                at += out.num_rows

    return carry


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows with the smallest id of each component of near copies. Rows with a null id, which take part, stay."""
    stays = near_copies(docs, id_col, text_col, **how).filter(F.col("component_id") == F.col(id_col)).select(F.col(id_col).alias("__stays")).distinct()
    named = docs.join(stays, F.col(f"`{id_col}`") == F.col("__stays"), "left_semi")
    return named.unionByName(docs.filter(F.col(f"`{id_col}`").isNull()))
