"""Token-id shards with a minimal perfect hash index.

Documents are put in order of id by a range shuffle of their texts, in as many ranges as their bytes ask for, and each
task encodes its range and packs it into shards of about ``shard_bytes``. Words are cut by the splitter of ``bpe``, which
the tests hold against the tokenizers library, and each distinct word is encoded by that library's model. A shard is one binary value: a header, the document table (ids and ends), the index
and the raw little-endian token ids, two bytes each where the vocabulary allows it. The index is a minimal perfect hash
over the shard's distinct document keys: levels of bits, at each of which the keys that no other key meets get a place;
a place holds the key's fingerprint and its row in the document table, so a lookup reads a handful of words whatever the
shard's size, and a key that isn't there is told by its fingerprint and then by its id. All reads of documents with an
id go through the index, whole scans too. Shards are rows of a Parquet table that Spark writes and reads, with the
smallest and largest id beside them, so any store that Spark reaches can hold them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Lexicon, byte_chars, chunks, load
from .common import arrow_map, fresh_path, pick, remembered

MAGIC, HEADER = b"TSHD0001", struct.Struct("<8sIIIIQ")  # magic, id width, rows, rows with a null id, levels, payload bytes
SHARD_BYTES = 4 << 20
#: Bits of a level for each key that is left, and levels before the rest is kept in order.
GAMMA, LEVELS = 2.0, 40
#: Bytes of text that one range holds, about.
RANGE_BYTES = 32 << 20
SCHEMA = "task int, nth int, first_id long, last_id long, n_docs long, n_tokens long, shard binary"


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer over integer keys."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Levels of bits and their ranks; ``slot`` gives each key of the set a number of its own below the set's size."""

    def __init__(self, bits: list[np.ndarray], rest: np.ndarray):
        self.bits, self.rest = bits, rest
        self.ranks = []
        total = 0
        for b in bits:
            before = np.cumsum(np.bitwise_count(b), dtype=np.int64)
            self.ranks.append(total + np.r_[0, before[:-1]] if len(b) else before)
            total += int(before[-1]) if len(b) else 0
        self.placed = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        bits, left = [], keys
        while len(left) and len(bits) < LEVELS:
            words = max(1, -(-int(GAMMA * len(left)) // 64))
            at = mix(left, len(bits)) % np.uint64(words * 64)
            alone = np.bincount(at.astype(np.int64), minlength=words * 64)[at.astype(np.int64)] == 1
            level = np.zeros(words, np.uint64)
            own = at[alone]
            np.bitwise_or.at(level, (own >> np.uint64(6)).astype(np.int64), np.uint64(1) << (own & np.uint64(63)))
            bits.append(level)
            left = left[~alone]
        return cls(bits, np.sort(left))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """-1 for a key that can't be in the set."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for k, (level, rank) in enumerate(zip(self.bits, self.ranks)):
            at = mix(keys[todo], k) % np.uint64(len(level) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            here = (level[word] >> bit & np.uint64(1)).astype(bool)
            below = level[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[here]] = (rank[word] + np.bitwise_count(below))[here]
            todo = todo[~here]
        if len(self.rest) and len(todo):
            at = np.searchsorted(self.rest, keys[todo])
            found = (at < len(self.rest)) & (self.rest[np.minimum(at, len(self.rest) - 1)] == keys[todo])
            out[todo[found]] = self.placed + at[found]
        return out


def pack(ids: np.ndarray, nulls: int, ends: np.ndarray, payload: np.ndarray) -> bytes:
    """A shard of rows in order: the first ``nulls`` have no id; ``ends`` is where each row's ids end in the payload."""
    keys, rows = np.unique(ids[nulls:], return_index=True)  # of rows that repeat an id, the first
    index = PerfectHash.build(keys.astype(np.int64).view(np.uint64))
    slot = index.slot(keys.astype(np.int64).view(np.uint64))
    row, mark = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint32)
    row[slot] = rows + nulls
    mark[slot] = fingerprints(keys)
    sizes = np.array([len(b) for b in index.bits] + [len(index.rest), len(keys)], np.uint64)
    return b"".join([HEADER.pack(MAGIC, payload.itemsize, len(ids), nulls, len(index.bits), payload.nbytes), sizes.tobytes(), ids.astype("<i8").tobytes(), ends.astype("<u8").tobytes(), *(b.tobytes() for b in index.bits), index.rest.tobytes(), row.tobytes(), mark.tobytes(), payload.tobytes()])


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64), 99) >> np.uint64(32)).astype(np.uint32)


class Shard:
    """Reads a shard; arrays are views of its bytes."""

    def __init__(self, data: bytes):
        magic, self.width, n, self.nulls, levels, payload = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, int(count), at)
            at += out.nbytes
            return out

        sizes = take("<u8", levels + 2)
        self.ids, self.ends = take("<i8", n), take("<u8", n)
        bits = [take("<u8", k) for k in sizes[:levels]]
        self.index = PerfectHash(bits, take("<u8", sizes[levels]))
        self.row, self.mark = take("<u4", sizes[levels + 1]), take("<u4", sizes[levels + 1])
        self.payload = memoryview(data)[at : at + payload]

    def tokens(self, row: int) -> np.ndarray:
        a = int(self.ends[row - 1]) if row else 0
        return np.frombuffer(self.payload, f"<u{self.width}", int(self.ends[row]) - a, a * self.width)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key by the index, fingerprint and id; -1 for one that isn't in the shard."""
        out = np.full(len(keys), -1, np.int64)
        slot = self.index.slot(keys.astype(np.int64).view(np.uint64))
        at = np.flatnonzero(slot >= 0)
        at = at[self.mark[slot[at]] == fingerprints(keys[at])]
        row = self.row[slot[at]].astype(np.int64)
        same = self.ids[row] == keys[at]
        out[at[same]] = row[same]
        return out

    def get(self, key: int) -> np.ndarray | None:
        """The ids of a document, in constant time; None if it isn't in the shard."""
        row = int(self.rows(np.array([key], np.int64))[0])
        return None if row < 0 else self.tokens(row)


_lexicons: dict = {}
remembered(("token_files",), _lexicons.clear)


def _library(path: str, end: int | None) -> Lexicon:
    """Encodes words with the tokenizers library's model; a worker's memory outlives its tasks."""
    if (path, end) not in _lexicons:
        from tokenizers import Tokenizer

        model, shown = Tokenizer.from_file(path).model, dict(enumerate(byte_chars()))
        encode = lambda words: [[t.id for t in model.tokenize(w.decode("latin-1").translate(shown))] for w in words]
        _lexicons[path, end] = Lexicon(load(path), encode, () if end is None else (end,))
    return _lexicons[path, end]


def _writer(path: str, width: int, end: int | None, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _library(path, end)
        task, nth, least = TaskContext.get().partitionId(), 0, max(1, shard_bytes // width)
        ids, sizes, payload = [], [np.empty(0, np.int64)], [np.empty(0, f"<u{width}")]

        def shards(last: bool) -> Iterator[pa.RecordBatch]:
            """Of what is held, whole shards; all of it at the end."""
            nonlocal nth, ids, sizes, payload
            size, flat = np.concatenate(sizes), np.concatenate(payload)
            ends = np.cumsum(size)
            at, begin = 0, 0
            while at < len(ids):
                to = int(np.searchsorted(ends, begin + least)) + 1
                if to > len(ids):
                    if not last:
                        break
                    to = len(ids)
                known = [i for i in ids[at:to] if i is not None]
                nulls = to - at - len(known)
                until = int(ends[to - 1])
                data = pack(np.array([0] * nulls + known, np.int64), nulls, ends[at:to] - begin, flat[begin:until])
                row = [task, nth, min(known, default=None), max(known, default=None), to - at, until - begin, data]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()))], names=[f.split()[0] for f in SCHEMA.split(", ")])
                nth, at, begin = nth + 1, to, until
            ids, sizes, payload = ids[at:], [size[at:]], [flat[begin:]]

        for batch in batches:
            ids_of, at = batch.column(0).to_pylist(), 0
            for texts in chunks(batch.column(1)):
                flat, ends = words.tokens(words.numbers(words.bpe.marked(texts)))
                ids += ids_of[at : at + len(texts)]
                sizes.append(np.diff(ends, prepend=0))
                payload.append(flat.astype(f"<u{width}"))
                at += len(texts)
                if sum(map(len, payload)) >= least:
                    yield from shards(False)
        yield from shards(True)

    return run


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All documents of each shard, those with an id found by their keys."""
    for batch in batches:
        task, nth, data = (batch.column(k).to_pylist() for k in range(3))
        for t, k, d in zip(task, nth, data):
            s = Shard(d)
            ids, row = s.ids, np.arange(len(s.ids))
            found = s.rows(ids[s.nulls :])
            again = np.r_[False, ids[s.nulls + 1 :] == ids[s.nulls : -1]] if len(found) else np.zeros(0, bool)  # the key finds the first
            if (found < 0).any() or (found != row[s.nulls :])[~again].any():
                raise ValueError("a shard's index doesn't find its documents")
            row[s.nulls :][~again] = found[~again]
            starts = np.r_[np.zeros(1, np.uint64), s.ends[:-1]].astype(np.int64)[row]
            ends = s.ends.astype(np.int64)[row]
            whole = memoryview(np.frombuffer(s.payload, f"<u{s.width}").astype("<u4")).cast("B")
            sums = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            same = lambda v: pa.array(np.full(len(row), v, np.int32))
            yield pa.RecordBatch.from_arrays([same(t), same(k), pa.array(ids, mask=np.arange(len(ids)) < s.nulls), pa.array(starts), pa.array(ends - starts), pa.array(sums, pa.int64())], names=["task", "nth", "id", "within", "n_tokens", "ids_crc32"])


def _getter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, row in order, ids) of keys that stand beside a shard; every key looked up by the shard's index."""
    for batch in batches:
        for keys, task, nth, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
            s, keys = Shard(data), np.array(keys, np.int64)
            row = s.rows(keys)
            found = np.flatnonzero(row >= 0)
            ids = [s.tokens(int(r)).astype(np.int64) for r in row[found]]
            yield pa.RecordBatch.from_arrays([pa.array(keys[found]), pa.array([task] * len(found), pa.int32()), pa.array([nth] * len(found), pa.int32()), pa.array(ids, pa.list_(pa.int64()))], names=["key", "task", "nth", "ids"])


class TokenFiles:
    """A folder of shards."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.shards = spark.read.schema(SCHEMA).parquet(path)

    @classmethod
    def write(cls, docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int | None = 0, shard_bytes: int = SHARD_BYTES, partitions: int | None = None) -> TokenFiles:
        """Encodes every whole text, appends the id ``end`` and writes all in ascending order of id.

        A null text counts as empty: only the end id. Rows with a null id come first and have no key; rows that repeat
        an id are ordered by their texts' hash and text, may fall in several ranges, and the key finds the first. An
        empty table writes no shard. Other columns aren't read.
        """
        spark = docs.sparkSession
        path = path or fresh_path(spark, "token-files")
        width = 2 if load(tokenizer).size <= 1 << 16 and (end or 0) < 1 << 16 else 4
        rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.col("text").cast("string"))
        if not partitions:
            held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
            partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // RANGE_BYTES))
        order = ("id", F.xxhash64("text"), "text")
        rows = rows.repartitionByRange(partitions, *order[:2]).sortWithinPartitions(*order)
        arrow_map(rows, _writer(tokenizer, width, end, shard_bytes), SCHEMA).write.option("compression", "none").parquet(path)
        return cls(spark, path)

    def starts(self) -> DataFrame:
        """(task, nth, base): ids before each shard. Only a total for each of the writer's tasks comes to the driver."""
        totals = self.shards.groupBy("task").agg(F.sum("n_tokens").alias("n")).orderBy("task").collect()
        base, at = [], 0
        for r in totals:
            base.append((r["task"], at))
            at += r["n"]
        bases = self.spark.createDataFrame(base, "task int, base long")
        within = F.sum("n_tokens").over(Window.partitionBy("task").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
        return self.shards.select("task", "nth", F.coalesce(within, F.lit(0)).alias("before")).join(F.broadcast(bases), "task").select("task", "nth", (F.col("base") + F.col("before")).alias("base"))

    def documents(self) -> DataFrame:
        """One row per document, read from the shards: id, start (ids of all documents before), n_tokens, ids_crc32."""
        docs = arrow_map(self.shards.select("task", "nth", "shard"), _reader, "task int, nth int, id long, within long, n_tokens long, ids_crc32 long")
        return docs.join(self.starts(), ["task", "nth"]).select("id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")

    def lookup(self, keys: list[int]) -> DataFrame:
        """(key, ids) of the documents among ``keys`` that are there; the executors open only shards whose range has one."""
        wanted = F.filter(F.array(*[F.lit(k).cast("long") for k in sorted(set(keys))]), lambda k: (F.col("first_id") <= k) & (F.col("last_id") >= k))
        near = self.shards.withColumn("keys", wanted).filter(F.size("keys") > 0).select("keys", "task", "nth", "shard")
        found = arrow_map(near, _getter, "key long, task int, nth int, ids array<long>")
        return found.groupBy("key").agg(F.min_by("ids", F.struct("task", "nth")).alias("ids"))  # a repeated id may stand in two shards

    def get(self, key: int) -> np.ndarray | None:
        """The ids of one document: its shard by the ranges beside the shards, its place by the shard's index."""
        got = self.lookup([key]).first()
        return None if got is None else np.array(got["ids"], np.int64)
