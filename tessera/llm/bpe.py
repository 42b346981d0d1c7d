"""Byte-level BPE: encoding by batched numpy merge rounds, and decoding.

Texts are cut into words (letters, digits, other marks, each with a leading space, and white space) by a splitter of
our own, which compares the classes of neighbouring characters in the flat bytes of many texts; the tests hold it
against the library's. Words not met before are encoded together: the symbols of all of them lie in one flat array,
every round looks up the ranks of all neighbouring pairs by binary search over the sorted pair keys, takes the lowest
rank of each word and merges its places, until no word has a pair left. Each worker remembers the words it has met, up
to a bound; a text's ids are its words' ids in order.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pick, remembered

#: Words that a worker remembers, and bytes that are cut at once.
REMEMBERED, AT_ONCE = 700_000, 8 << 20
SPACE, LETTER, DIGIT, OTHER, EDGE, UNKNOWN = range(6)
_POINTS = 0x110000
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


@lru_cache(1)
def _classes() -> np.ndarray:
    return np.full(_POINTS, UNKNOWN, np.uint8)


def _class(c: str) -> int:
    """By Unicode category; characters newer than Python's tables are asked of the tokenizers library's splitter."""
    kind = unicodedata.category(c)
    if kind == "Cn":
        from tokenizers.pre_tokenizers import ByteLevel

        joins = lambda x: len(ByteLevel(add_prefix_space=False).pre_tokenize_str(x + c)) == 1
        return LETTER if joins("a") else DIGIT if joins("1") else OTHER
    white = kind[0] == "Z" or c in "\t\n\x0b\f\r\x85"
    return SPACE if white else LETTER if kind[0] == "L" else DIGIT if kind[0] == "N" else OTHER


def _classify(points: np.ndarray) -> np.ndarray:
    """Unicode classes; characters are looked up when first met."""
    table = _classes()
    cls = table[points]
    if (cls == UNKNOWN).any():
        for p in np.unique(points[cls == UNKNOWN]).tolist():
            table[p] = _class(chr(p))
        cls = table[points]
    return cls


#: Bytes that UTF-8 never holds: the end of a text, the begin of an added token's mark, and that mark's digits.
END, MARK, MARK_DIGITS = 0xFF, 0xFE, range(0xF5, 0xFE)


@lru_cache(1)
def _byte_classes() -> np.ndarray:
    """ASCII characters' classes; bytes of longer characters get theirs when they are read."""
    table = np.full(256, UNKNOWN, np.uint8)
    table[:128] = _classify(np.arange(128))
    table[MARK_DIGITS[0] :] = EDGE
    return table


def split(buf: np.ndarray) -> np.ndarray:
    """Where the words of UTF-8 bytes begin. The bytes end with END; marks of added tokens are words of their own."""
    cls = _byte_classes()[buf]
    lead = np.flatnonzero((buf >= 0xC2) & (buf < MARK_DIGITS[0]))
    if len(lead):
        head = buf[lead].astype(np.uint32)
        two, four = head < 0xE0, head >= 0xF0
        c1, c2, c3 = (buf[np.minimum(lead + k, len(buf) - 1)].astype(np.uint32) & 0x3F for k in (1, 2, 3))
        point = np.where(two, (head & 0x1F) << 6 | c1, np.where(four, (head & 7) << 18 | c1 << 12 | c2 << 6 | c3, (head & 0xF) << 12 | c1 << 6 | c2))
        kind = _classify(point)
        for k, has in enumerate((slice(None), slice(None), ~two, four)):
            cls[lead[has] + k] = kind[has]
    before = np.empty_like(cls)
    before[0], before[1:] = EDGE, cls[:-1]
    space = cls == SPACE
    after_plain = np.r_[False, buf[:-1] == 0x20]
    # a word begins where the class changes, but a plain space before it belongs to it
    begins = (before != cls) & ~(after_plain & ~space)
    # of white space, the last character stands for itself if a word follows
    last = np.flatnonzero(space[:-1] & ~space[1:] & (cls[1:] != EDGE))
    while (inside := buf[last] & 0xC0 == 0x80).any():
        last = last - inside
    begins[last] = True
    begins[buf >= MARK] = True
    marks = np.flatnonzero(buf == ord("'"))
    marks = marks[begins[marks] & (before[marks] != OTHER) & ~after_plain[marks]]
    for c in CONTRACTIONS if len(marks) else ():
        at = marks[buf[marks + 1] == ord(c[1])]
        if len(c) == 3:
            at = at[buf[at + 2] == ord(c[2])]
        begins[at + 1] = False
        end = at + len(c)
        begins[end[cls[end] == LETTER]] = True
    return np.flatnonzero(begins)


class BPE:
    """Vocabulary, pair ranks and added tokens of a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        named = sorted((t.encode() for t in self.added), key=len, reverse=True)
        width = max(1, math.ceil(math.log(max(2, len(named)), len(MARK_DIGITS))))
        self.marks = {t: bytes([MARK, *(MARK_DIGITS[k // len(MARK_DIGITS) ** j % len(MARK_DIGITS)] for j in range(width))]) for k, t in enumerate(named)}
        self.pattern = re.compile(b"|".join(map(re.escape, named))) if named else None
        chars = byte_chars()
        back = {c: bytes([b]) for b, c in enumerate(chars)}
        self.bytes = {i: b"".join(back[c] if c in back else c.encode() for c in t) for t, i in vocab.items()}
        self.bytes |= {i: t.encode() for t, i in self.added.items()}
        self.first = np.array([vocab[c] for c in chars], np.int64)
        self.size = max(self.bytes) + 1
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, pairs[:, 2]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, all words merged together."""
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        never, done = len(self.made), []
        while len(sym):
            key = sym[:-1] * self.size + sym[1:]
            rank = np.full(len(sym), never)
            if never:
                at = np.minimum(np.searchsorted(self.keys, key), never - 1)
                known = (self.keys[at] == key) & (word[1:] == word[:-1])
                rank[:-1][known] = self.ranks[at[known]]
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[heads, len(sym)])
            low = np.minimum.reduceat(rank, heads)
            each = np.repeat(low, lengths)
            going = each < never
            done.append((word[~going], sym[~going]))
            # of places that overlap (the same symbol again and again) every other one merges
            places = np.flatnonzero((rank == each) & going)
            if len(places):
                nth = np.arange(len(places))
                nth -= np.maximum.accumulate(np.where(np.r_[True, np.diff(places) != 1], nth, 0))
                places = places[nth % 2 == 0]
                sym[places] = self.made[rank[places]]
                going[places + 1] = False
            sym, word = sym[going], word[going]
        if not done:
            return [[] for _ in words]
        owner, ids = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        ends = np.cumsum(np.bincount(owner, minlength=len(words))).tolist()
        flat = ids[np.argsort(owner, kind="stable")].tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def decode(self, ids) -> str:
        return b"".join(self.bytes.get(i, b"") for i in ids).decode("utf-8", "replace")

    def marked(self, texts: list[bytes]) -> bytes:
        """All texts in a row, each ended by END, their added tokens replaced by marks."""
        data = b"".join([x for t in texts for x in (t, b"\xff")])
        return self.pattern.sub(lambda m: self.marks[m[0]], data) if self.pattern and self.pattern.search(data) else data

    def encode(self, text: str) -> list[int]:
        words = Lexicon(self, self.encode_words)
        ids, _ = words.tokens(words.numbers(self.marked([text.encode()])))
        return ids.tolist()


@lru_cache(2)
def load(path: str) -> BPE:
    return BPE(path)


class Lexicon:
    """Numbers for the words met, and their ids in one flat array.

    An Arrow dictionary finds the distinct words of many texts at once; only words not met before are encoded. Number 0
    is the end of a text, whose ids are ``end``. Above ``limit`` words, those of the texts at hand alone are remembered.
    """

    def __init__(self, bpe: BPE, encode, end: tuple = (), limit: int = REMEMBERED, kept=None):
        self.bpe, self.encode, self.limit, self.kept = bpe, encode, limit, kept
        self.always = [(bytes([END]), list(end)), *((mark, [bpe.added[t.decode()]]) for t, mark in bpe.marks.items())]
        self.forget()

    def forget(self) -> None:
        self.at, self.flat, self.begin, self.size, self.cells = {}, np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), []
        self.learn([w for w, _ in self.always], [ids for _, ids in self.always])

    def learn(self, words: list[bytes], ids: list[list[int]]) -> None:
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words))))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(n) - n])
        self.size = np.concatenate([self.size, n])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))])
        if self.kept:
            self.cells += map(self.kept, ids)

    def numbers(self, data: bytes) -> np.ndarray:
        """The number of each word of marked texts, in order."""
        buf = np.frombuffer(data, np.uint8)
        if not len(buf):
            return np.empty(0, np.int64)
        starts = np.append(split(buf), len(buf)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        words = found.dictionary.to_pylist()
        if len(self.at) > self.limit:
            self.keep(words)
        number = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            number[fresh] = len(self.at) + np.arange(len(fresh))
            new = [words[k] for k in fresh.tolist()]
            self.learn(new, self.encode(new))
        return number[found.indices.to_numpy()]

    def keep(self, words: list[bytes]) -> None:
        """Forgets all but these."""
        marks = {w for w, _ in self.always}
        known = [(w, self.at[w]) for w in words if w in self.at and w not in marks]
        ids = [self.flat[self.begin[k] : self.begin[k] + self.size[k]].tolist() for _, k in known]
        self.forget()
        self.learn([w for w, _ in known], ids)

    def tokens(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and where each text's end."""
        n = self.size[numbers]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begin[numbers] - ends + n, n)
        return self.flat[at], ends[numbers == 0]

    def of(self, numbers: np.ndarray) -> Iterator[list]:
        """What was kept of the words of each text."""
        at = 0
        for end in np.flatnonzero(numbers == 0).tolist():
            yield [self.cells[k] for k in numbers[at:end].tolist()]
            at = end + 1


def chunks(column: pa.Array, size: int = AT_ONCE) -> Iterator[list[bytes]]:
    """A column's texts as bytes, null as empty, about ``size`` bytes at a time; a longer text alone."""
    held, n = [], 0
    for t in column.cast(pa.binary()).to_pylist():
        held.append(t or b"")
        n += len(held[-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


_lexicons: dict = {}


def _forget() -> None:
    _lexicons.clear()
    load.cache_clear()


remembered(("bpe",), _forget)


def _worker_lexicon(path: str, kind: str, kept) -> Lexicon:
    """A worker's own memory outlives its tasks, until one of another operator begins."""
    if (path, kind) not in _lexicons:
        bpe = load(path)
        _lexicons[path, kind] = Lexicon(bpe, bpe.encode_words, kept=kept(bpe))
    return _lexicons[path, kind]


def _listed(bpe: BPE):
    decimal = [b"%d" % i for i in range(bpe.size)]
    return lambda ids: (b",".join([decimal[i] for i in ids]), b"".join([bpe.bytes[i] for i in ids]))


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _worker_lexicon(path, "listed", _listed)
        for batch in batches:
            n, ids, back = [], [], []
            for texts in chunks(batch.column(1)):
                numbers = words.numbers(words.bpe.marked(texts))
                n.append(np.diff(np.cumsum(words.size[numbers])[numbers == 0], prepend=0))
                for got in words.of(numbers):
                    ids.append(hashlib.sha256(b",".join([g[0] for g in got])).hexdigest())
                    back.append(hashlib.sha256(b"".join([g[1] for g in got]).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n) if n else [], pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _round(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _worker_lexicon(path, "back", lambda bpe: lambda ids: b"".join([bpe.bytes[i] for i in ids]))
        for batch in batches:
            ids, sizes, decoded = [np.empty(0, np.int32)], [np.zeros(1, np.int64)], []
            for texts in chunks(batch.column(1)):
                numbers = words.numbers(words.bpe.marked(texts))
                flat, ends = words.tokens(numbers)
                ids.append(flat)
                sizes.append(np.diff(ends, prepend=0))
                decoded += [b"".join(got).decode("utf-8", "replace") for got in words.of(numbers)]
            listed = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), listed, pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.col("text").cast("string"))


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids array<int>, decoded. A null text counts as empty: no ids. Rows that repeat are encoded alike."""
    return arrow_map(_rows(docs, id_col, text_col), _round(path), "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same round trip, returning per row n_tokens and the SHA-256 of the ids (decimal, comma-joined) and of the decoded text."""
    return arrow_map(_rows(docs, id_col, text_col), _digests(path), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
