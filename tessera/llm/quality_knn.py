"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent-semantic space.

Texts become counts of hashed byte trigrams, damped, weighted by inverse document frequency and projected on the
leading singular vectors of a labelled sample. The sample's vectors and the projection are broadcast, a fixed size
whatever the corpus; every document is compared with all of them by blocked exact cosine products, and its ``k`` nearest vote
with their similarity. The sample holds as many rows of either label, and votes are weighted back to the shares of the
labels among all labelled rows.

Only the fit is bounded: SAMPLE rows of each label at most, chosen by a hash of their ids. Every document is scored on
its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, pick

#: Hashed terms, singular vectors, labelled rows of each label at most, neighbours that vote, documents of a block.
TERMS, DIMS, SAMPLE, NEIGHBOURS, BLOCK = 4096, 48, 2000, 15, 256
#: The last two terms, shares of words that repeat the one before or the one before that, in thousandths; their weight.
#: The weight, the exponent of a vote and the number of neighbours are those of the best mean of kept good and caught bad rows in a
#: cross-validation over folds 1 to 4, the rows that are learned from; fold 0 took no part.
REPEAT, REPEAT_WEIGHT, SHARP = 1000.0, 8.0, 8
THRESHOLD, FOLDS = 0.3, 5
#: A text with less of its unit length than this in the latent space has nothing in common with it.
FAINT = 1e-4


def term_counts(text: str | None) -> np.ndarray:
    """Counts of the text's hashed byte trigrams (shorter texts are one), and how often its words repeat at once."""
    raw = (text or "").encode()
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if not len(b):
        return np.zeros(TERMS, np.float32)
    if len(b) < 3:
        b = np.r_[b, np.zeros(3 - len(b), np.uint32)]
    code = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
    counts = np.bincount((code >> np.uint32(8)) % np.uint32(TERMS - 2), minlength=TERMS).astype(np.float32)
    words = raw.split()
    for back in (1, 2):
        counts[-back] = REPEAT * sum(map(eq, words, words[back:])) / max(1, len(words))
    return counts


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray  # weight of each labelled row
    good: np.ndarray
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_unit(np.log1p(counts) * self.idf) @ self.axes, FAINT)

    def scores(self, texts: list[str | None], k: int = NEIGHBOURS) -> np.ndarray:
        """Between 0 and 1, higher where label 1 is likelier; the labels' prior where nothing is similar."""
        out = np.full(len(texts), self.prior)
        if not len(self.vectors):
            return out
        k = min(k, len(self.vectors))
        for at in range(0, len(texts), BLOCK):
            near = self.embed(np.stack([term_counts(t) for t in texts[at : at + BLOCK]])) @ self.vectors.T
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            sim = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** SHARP * self.votes[top]
            whole = sim.sum(1)
            out[at : at + len(near)][whole > 0] = ((sim * self.good[top]).sum(1)[whole > 0] / whole[whole > 0]).clip(0, 1)
        return out


def _unit(x: np.ndarray, least: float = 0.0) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > least)


def fit_counts(counts: np.ndarray, good: np.ndarray, shares: tuple[float, float], dims: int = DIMS, seed: int = 5) -> Model:
    """From term counts and labels of the sample, and the shares of labels 0 and 1 among all labelled rows."""
    n = len(counts)
    idf = np.log((1 + n) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    idf[-2:] *= REPEAT_WEIGHT
    x = _unit(np.log1p(counts) * idf) if n else np.zeros((0, TERMS), np.float32)
    dims = min(dims, n, TERMS)
    y = np.random.default_rng(seed).standard_normal((TERMS, dims + 16)).astype(np.float32)
    for _ in range(4 if n else 0):  # subspace iteration
        y = np.linalg.qr(x.T @ (x @ y))[0]
    axes = y[:, :dims]
    if n:
        u = np.linalg.svd(x @ y, full_matrices=False)[2]
        axes = (y @ u.T)[:, :dims]
    have = np.bincount(good.astype(int), minlength=2)
    votes = np.where(good == 1, shares[1] / max(have[1], 1), shares[0] / max(have[0], 1)) * max(n, 1)
    model = Model(idf, np.ascontiguousarray(axes, np.float32), np.zeros((0, dims), np.float32), votes, good.astype(np.float64), shares[1] if n else 0.5)
    model.vectors = model.embed(counts) if n else model.vectors
    return model


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % FOLDS == 0


def _sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column(2):
            c = term_counts(text.as_py())
            at = np.flatnonzero(c)
            out.append(at.astype("<u2").tobytes() + c[at].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "label", "terms"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, dims: int = DIMS) -> Model:
    """Learns from at most ``sample`` rows of each label that aren't held out; ids and labels that are null don't count, rows that repeat count once."""
    known = pick(labels, id=id_col, label=label_col).filter("label in (0, 1) and id is not null").filter(~held_out("id")).distinct()
    shares = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    part = lambda v: known.filter(F.col("label") == v).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(sample)
    chosen = part(0).unionByName(part(1))
    rows = pick(docs, id=id_col, text=text_col).join(F.broadcast(chosen), "id").select("id", "label", "text")  # 2 * sample rows
    got = arrow_map(rows.withColumn("label", F.col("label").cast("int")), _sample_terms, f"id {rows.schema['id'].dataType.simpleString()}, label int, terms binary").collect()
    got = sorted({(r["id"], r["label"], bytes(r["terms"])) for r in got})
    counts = np.zeros((len(got), TERMS), np.float32)
    for k, (_, _, b) in enumerate(got):
        n = len(b) // 6
        counts[k, np.frombuffer(b, "<u2", n)] = np.frombuffer(b, "<f4", n, 2 * n)
    total = max(1, sum(shares.values()))
    return fit_counts(counts, np.array([label for _, label, _ in got], np.int64), (shares.get(0, 0) / total, shares.get(1, 0) / total), dims)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with all their columns and ``out_col``, which replaces one of that name; a null or empty text has the prior.

    Rows that repeat score alike. An empty table gives no rows.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == out_col.lower()])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.scores(part.column(at).to_pylist()))], names=[*part.schema.names, out_col])

    return arrow_map(docs, run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())]))


def accept(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score at least ``threshold``, with all their columns."""
    return score(docs, model, text_col, "__score").filter(F.col("__score") >= threshold).drop("__score")
