"""Removal of repeated passages with fixed-block anchors.

A passage of ``window`` words that occurs twice holds, wherever it begins, a whole block of ``window / 2`` words
that lies on the fixed grid of its other occurrence. So every document's non-overlapping blocks are indexed, every
rolling window of a block's length probes that index, and a probe that meets a block elsewhere is an anchor. Around
anchors, windows of full length are compared, which extends each anchor to the maximal stretch that repeats.
The first occurrence of each window, by document id and place, stays; words under later ones go.

Words are told apart by XXH3 of 128 bits, windows by two polynomials of 64 bits over the halves of these, each with a
multiplier of its own: no pattern of words makes two windows alike, and by chance two of n windows are with a
probability below n * n / 2**100.

Documents are packed into units of about ``unit_bytes``, written once as a bucketed table that later joins read
without a shuffle. Only hashes are shuffled, as sorted and delta-coded arrays per unit and slice of the hash space: probes and blocks
as short keys with room to spare for the corpus's size (a false anchor only costs a comparison), full windows as 128 bits with
their document. A unit sends each hash once, so a passage in a third of all documents is one entry per unit, and no slice
gathers more than its share of the hash space.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fresh_path, pick, ship, stage
from .token_files import mix

WINDOW, UNIT_BYTES = 20, 8 << 20
#: Windows that a slice of the hash space holds, about; bits of a short key beyond those that count the corpus's words.
SLICE_WINDOWS, SPARE_BITS = 4 << 20, 13
#: Odd multipliers of the words' two hashes; bytes of text of a bucket of units, about, and buckets at most (Spark's own limit).
WORD_MUL, OTHER_MUL = 0xC2B2AE3D27D4EB4F, 0x9E3779B97F4A7C55
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 100_000
PACKED = "unit long, ids array<long>, ties array<int>, counts array<int>, body binary"


def word_hashes(body: bytes) -> np.ndarray:
    """Two 64-bit hashes, as the columns of an array, of each word of ``body``; every word is followed by one space."""
    from xxhash import xxh3_128_digest

    ends = np.flatnonzero(np.frombuffer(body, np.uint8) == 32) + 1
    if not len(ends):
        return np.empty((2, 0), np.uint64)
    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends]), pa.py_buffer(body)]).dictionary_encode()
    each = np.frombuffer(b"".join(map(xxh3_128_digest, words.dictionary.to_pylist())), "<u8").reshape(-1, 2).T
    return each[:, words.indices.to_numpy()]


class Unit:
    """The hashes of a packed unit: of rolling blocks, and of full windows where asked."""

    def __init__(self, counts: list[int], body: bytes, window: int):
        self.window, self.block = window, window // 2
        self.words, self.others = word_hashes(body)
        counts = np.asarray(counts, np.int64)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        first = np.cumsum(counts) - counts
        self.left = (first + counts)[self.doc] - np.arange(len(self.words))  # words from here to the document's end
        self.place = np.arange(len(self.words)) - first[self.doc]
        n = max(0, len(self.words) - self.block + 1)
        self.raw = np.zeros(n, np.uint64)
        for j in range(self.block):
            self.raw = self.raw * np.uint64(WORD_MUL) + self.words[j : j + n]

    def probes(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Short keys of all places, and whether a block's length is left there."""
        return mix(self.raw, 5) >> np.uint64(64 - bits), self.left[: len(self.raw)] >= self.block

    def candidates(self, hits: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Full windows around anchors: places, and their distinct hashes (twice 64 bits) in order with each place's number.

        hits: sorted short keys that other units' blocks answered; the unit's own blocks answer here.
        """
        key, whole = self.probes(bits)
        anchor = np.zeros(len(key), bool)
        if len(hits):
            at = np.minimum(np.searchsorted(hits, key), len(hits) - 1)
            anchor = hits[at] == key
        grid = np.flatnonzero(whole & (self.place[: len(key)] % self.block == 0))
        own, count = np.unique(key[grid], return_counts=True)
        if len(own):
            at = np.minimum(np.searchsorted(own, key), len(own) - 1)
            on_grid = np.zeros(len(key), bool)
            on_grid[grid] = True
            anchor |= (own[at] == key) & (count[at] > on_grid)  # a block doesn't answer itself
        anchor &= whole
        n = max(0, len(self.words) - self.window + 1)
        seen = np.r_[0, np.cumsum(anchor)]
        reach = self.window - self.block + 1
        starts = np.arange(n)
        places = np.flatnonzero((seen[np.minimum(starts + reach, len(key))] > seen[starts]) & (self.left[:n] >= self.window))
        full = self.raw[places] * np.uint64(pow(WORD_MUL, self.block, 1 << 64)) + self.raw[places + self.block]
        if self.window % 2:
            full = full * np.uint64(WORD_MUL) + self.words[places + self.window - 1]
        other = np.zeros(len(places), np.uint64)
        for j in range(self.window):
            other = other * np.uint64(OTHER_MUL) + self.others[places + j]
        high, low = mix(full, 7), mix(other, 9)
        order = np.lexsort((places, low, high))
        fresh = np.r_[True, (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)] if len(order) else np.zeros(0, bool)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        return places, number, high[order][fresh], low[order][fresh]


def put(values: np.ndarray) -> bytes:
    """Ascending integers as differences, byte plane by byte plane, so that high bytes compress."""
    d = np.diff(values, prepend=np.uint64(0))
    d = d.astype("<u4") if not len(d) or int(d.max()) < 1 << 32 else d.astype("<u8")
    return bytes([d.itemsize]) + np.ascontiguousarray(d.view(np.uint8).reshape(-1, d.itemsize).T).tobytes()


def get(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel(), dtype=np.uint64)


def _pack(unit_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh32_intdigest

        task, nth, held, size = TaskContext.get().partitionId(), 0, [], 0

        def unit() -> pa.RecordBatch:
            held.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
            body = zlib.compress(b"".join(h[3] for h in held), 1)
            columns = [pa.array([task << 32 | nth]), *(pa.array([[h[k] for h in held]], pa.list_(t)) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))), pa.array([body], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["unit", "ids", "ties", "counts", "body"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or "").encode().split()  # of bytes: ASCII white space only
                body = b" ".join(words) + b" " if words else b""
                held.append((key, xxh32_intdigest(body) - (1 << 31), len(words), body))
                size += len(body) + 16
                if size >= unit_bytes:
                    yield unit()
                    nth, held, size = nth + 1, [], 0
        if held:
            yield unit()

    return run


def _slices(keys: np.ndarray, bits: int, slices: int) -> np.ndarray:
    """Where each slice's keys begin among sorted keys of ``bits`` bits."""
    return np.searchsorted(keys, np.arange(slices + 1, dtype=np.uint64) << np.uint64(bits - int(math.log2(slices))))[: slices + 1] if slices > 1 else np.array([0, len(keys)])


def _send_probes(window: int, bits: int, slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, counts, body in zip(*(batch.column(k).to_pylist() for k in range(3))):
                u = Unit(counts, zlib.decompress(body), window)
                key, whole = u.probes(bits)
                grid = whole & (u.place[: len(key)] % u.block == 0)
                probes, blocks = np.unique(key[whole]), np.unique(key[grid])
                p, b = _slices(probes, bits, slices), _slices(blocks, bits, slices)
                p[-1], b[-1] = len(probes), len(blocks)
                some = np.flatnonzero(np.diff(p)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([unit] * len(some), pa.int64()), pa.array([put(probes[p[s] : p[s + 1]]) for s in some], pa.binary()), pa.array([put(blocks[b[s] : b[s + 1]]) for s in some], pa.binary())], names=["slice", "unit", "probes", "blocks"])

    return run


def _answer_probes(table: pa.Table) -> pa.Table:
    """Of a slice: for each unit, the probes that a block of another unit answers."""
    units = table.column("unit").to_numpy()
    blocks = [get(x) for x in table.column("blocks").to_pylist()]
    key, owner = np.concatenate(blocks), np.repeat(units, [len(b) for b in blocks])
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    tail = np.r_[head[1:], len(key)] - 1 if len(key) else head
    key, low, high = key[head], owner[head], owner[tail]
    out_units, out_hits = [], []
    for unit, data in zip(units.tolist(), table.column("probes").to_pylist()):
        probes = get(data)
        if not len(key):
            break
        at = np.minimum(np.searchsorted(key, probes), len(key) - 1)
        hit = (key[at] == probes) & ((low[at] != unit) | (high[at] != unit))
        if hit.any():
            out_units.append(unit)
            out_hits.append(put(probes[hit]))
    return pa.table({"unit": pa.array(out_units, pa.int64()), "hits": pa.array(out_hits, pa.binary())})


def _hits(listed: list[bytes] | None) -> np.ndarray:
    return np.unique(np.concatenate([get(x) for x in listed])) if listed else np.empty(0, np.uint64)


def _planes(values: np.ndarray) -> bytes:
    """Byte plane by byte plane, so that equal bytes compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _from_planes(data: list[bytes], kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.concatenate([np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(width, -1).T).view(kind).ravel() for x in data])


def _send_windows(window: int, bits: int, slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, ids, ties, counts, body, hits in zip(*(batch.column(k).to_pylist() for k in range(6))):
                u = Unit(counts, zlib.decompress(body), window)
                places, number, high, low = u.candidates(_hits(hits), bits)
                first = np.full(len(high), len(u.words))
                np.minimum.at(first, number, places)
                order = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
                of = u.doc[first] if len(first) else np.empty(0, np.int64)
                doc, tie = order[of], np.array(ties, np.int32)[of]
                at = _slices(high, 64, slices)
                at[-1] = len(high)
                some = np.flatnonzero(np.diff(at)).tolist()
                part = lambda x, s: x[at[s] : at[s + 1]]  # noqa: B023, E731
                sent = [[put(part(high, s)) for s in some], [part(low, s).tobytes() for s in some], [_planes(part(doc, s)) for s in some], [part(tie, s).tobytes() for s in some]]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([unit] * len(some), pa.int64()), *(pa.array(x, pa.binary()) for x in sent)], names=["slice", "unit", "high", "low", "doc", "tie"])

    return run


def _answer_windows(table: pa.Table) -> pa.Table:
    """Of a slice: for each unit, a bit per hash that it sent, set if another unit has the first occurrence."""
    units = table.column("unit").to_numpy()
    highs = [get(x) for x in table.column("high").to_pylist()]
    sizes = [len(h) for h in highs]
    high, owner = np.concatenate(highs), np.repeat(np.arange(len(units)), sizes)
    low, tie = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("low", "<u8"), ("tie", "<i4")))
    doc = _from_planes(table.column("doc").to_pylist(), "<i8")
    order = np.lexsort((units[owner], tie, doc, low, high))
    h, w = high[order], low[order]
    later = np.empty(len(order), bool)
    later[order] = np.r_[False, (h[1:] == h[:-1]) & (w[1:] == w[:-1])] if len(order) else later
    ends = np.cumsum(sizes)
    bits = [np.packbits(later[e - n : e]).tobytes() for e, n in zip(ends, sizes)]
    return pa.table({"unit": pa.array(units, pa.int64()), "slice": table.column("slice"), "later": pa.array(bits, pa.binary())})


def _remove(window: int, bits: int, slices: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, counts, body, hits, answers in zip(*(batch.column(k).to_pylist() for k in range(5))):
                body = zlib.decompress(body)
                u = Unit(counts, body, window)
                places, number, high, _ = u.candidates(_hits(hits), bits)
                at = _slices(high, 64, slices)
                at[-1] = len(high)
                later = np.zeros(len(high), bool)
                for a in answers or []:
                    s, data = a["slice"], a["later"]
                    later[at[s] : at[s + 1]] = np.unpackbits(np.frombuffer(data, np.uint8), count=int(at[s + 1] - at[s])).astype(bool)
                first = np.full(len(high), len(u.words))
                np.minimum.at(first, number, places)
                again = places[later[number] | (places != first[number])]
                edge = np.zeros(len(u.words) + 1, np.int64)
                np.add.at(edge, again, 1)
                np.add.at(edge, again + window, -1)
                goes = np.cumsum(edge[:-1]) > 0
                words = body.split()
                out, at_word = [], 0
                for n in counts:
                    gone = goes[at_word : at_word + n]
                    mine = words[at_word : at_word + n]
                    if removed := int(gone.sum()):
                        mine = list(compress(mine, (~gone).tolist()))
                    kept = b" ".join(mine)
                    out.append((n, removed, kept.decode() if texts else sha256(kept).hexdigest()))
                    at_word += n
                columns = [pa.array(ids, pa.int64()), *(pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_removed", "kept"])

    return run


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, unit_bytes: int = UNIT_BYTES, texts: bool = True) -> DataFrame:
    """One row per input row: id, n_words, n_removed, and kept_text (or its SHA-256, kept_sha256, without ``texts``).

    Words are what ASCII white space separates; kept ones are joined by one space. Of windows that repeat, the one in
    the smallest id, and there the first, stays. A null text has no words. Rows with a null id come after all others;
    rows that repeat an id are ordered by a hash of their words, so a rerun over other partitions removes the same
    words. Texts below ``window`` words lose nothing. An empty table gives no rows; other columns aren't read.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.col("text").cast("string"))
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // BUCKET_BYTES)))
    name = f"tessera_units_{uuid.uuid4().hex}"
    try:
        arrow_map(rows, _pack(unit_bytes), PACKED).write.bucketBy(buckets, "unit").option("path", fresh_path(spark, "units")).option("compression", "none").saveAsTable(name)
        done = _dedup(spark.table(name), window, texts)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return done.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").alias("kept_text" if texts else "kept_sha256"))


def _dedup(units: DataFrame, window: int, texts: bool) -> DataFrame:
    words = units.agg(F.sum(F.expr("aggregate(counts, 0L, (a, n) -> a + n)"))).first()[0] or 0
    bits = min(60, max(24, int(words).bit_length() + SPARE_BITS))
    slices = 1 << max(0, (int(words) // SLICE_WINDOWS).bit_length())

    probes = arrow_map(units.select("unit", "counts", "body"), _send_probes(window, bits, slices), "slice int, unit long, probes binary, blocks binary")
    hits = probes.groupBy("slice").applyInArrow(_answer_probes, "unit long, hits binary")
    hits = stage(hits.groupBy("unit").agg(F.collect_list("hits").alias("hits")), "anchors")  # a row of each slice at most
    anchored = units.join(hits, "unit", "left")
    sent = arrow_map(anchored.select("unit", "ids", "ties", "counts", "body", "hits"), _send_windows(window, bits, slices), "slice int, unit long, high binary, low binary, doc binary, tie binary")
    answers = sent.groupBy("slice").applyInArrow(_answer_windows, "unit long, slice int, later binary")
    answers = stage(answers.groupBy("unit").agg(F.collect_list(F.struct("slice", "later")).alias("answers")), "answers")
    last = anchored.join(answers, "unit", "left").select("ids", "counts", "body", "hits", "answers")
    return stage(arrow_map(last, _remove(window, bits, slices, texts), "id long, n_words long, n_removed long, kept string"), "passages")
