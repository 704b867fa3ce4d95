"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text has three blocks of terms: its words, by a hash of each; runs of four letters, by a hash, so that word parts count too;
and shapes, which are runs of three character classes (so that no language is favoured) and words equal to one of the
words shortly before.  Counts are damped, weighted by inverse document frequency and scaled block by block, then
projected on the leading singular vectors of the labelled sample.  The vectors of that sample, a bounded number by the
parameter ``fit_rows``, are broadcast; each document's cosines with all of them are exact products by blocks, and its
nearest neighbours vote with weights that grow with the cosine.

Fitting reads labelled texts only, and of these the ``fit_rows`` with the smallest hash of their id.  Scoring is a map
over whole texts: no shuffle, nothing is kept between rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import pieces

#: Sizes of the hashed blocks; the shapes are followed by the words that equal one before.
SHAPES, AGAIN, WORD_TERMS, LETTER_TERMS = 1024, 8, 2048, 1024
#: Columns of each block and its share in a text's vector.
BLOCKS = ((0, SHAPES + AGAIN, 1.0), (SHAPES + AGAIN, SHAPES + AGAIN + WORD_TERMS, 0.5), (SHAPES + AGAIN + WORD_TERMS, SHAPES + AGAIN + WORD_TERMS + LETTER_TERMS, 0.5))
WIDTH = BLOCKS[-1][1]
#: Texts are counted in slices of so many bytes and at most so many texts, as a row of counts is WIDTH numbers.
SLICE, SLICE_TEXTS = 500_000, 512
#: An equal word counts this much, as it stands for several characters.
AGAIN_WEIGHT = 4
RESULT = ("held_out", "score", "predicted")


def _byte_classes() -> np.ndarray:
    """Letters share a class by case, digits and bytes beyond ASCII one each; other characters stand for themselves."""
    table = np.arange(256)
    table[ord("a") : ord("z") + 1] = 200
    table[ord("A") : ord("Z") + 1] = 201
    table[ord("0") : ord("9") + 1] = 202
    table[128:] = 200
    return table.astype(np.int64)


CLASSES = _byte_classes()
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    for a, b in pieces.sliced([len(t) for t in texts], SLICE):
        for x in range(a, b, SLICE_TEXTS):
            yield x, min(x + SLICE_TEXTS, b)


def term_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of terms, a row for each text (UTF-8)."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    owner = np.repeat(np.arange(len(texts)), sizes)
    at: list[np.ndarray] = []  # places in the table of counts
    if len(raw) >= 3:
        kind = CLASSES[raw]
        three = ((kind[:-2] * 203 + kind[1:-1]) * 203 + kind[2:]).astype(np.uint64)
        same = owner[:-2] == owner[2:]
        at.append((owner[:-2] * WIDTH + ((three * GOLDEN) >> np.uint64(54)).astype(np.int64))[same])
    small = np.frombuffer(raw.tobytes().lower(), np.uint8)
    if len(raw) >= 4:
        x = small.astype(np.uint64)
        four = ((x[:-3] << np.uint64(8) | x[1:-2]) << np.uint64(8) | x[2:-1]) << np.uint64(8) | x[3:]
        same = owner[:-3] == owner[3:]
        at.append((owner[:-3] * WIDTH + BLOCKS[2][0] + ((four * GOLDEN) >> np.uint64(54)).astype(np.int64))[same])
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    if len(begin):
        with np.errstate(over="ignore"):  # words meet in few places anyway, so a plain hash of their letters will do
            base, back = pieces._powers(len(raw) + 1)
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((small.astype(np.uint64) + np.uint64(1)) * base[:-1], out=sums[1:])
            word = (sums[end] - sums[begin]) * back[begin]
            place = ((word ^ (word >> np.uint64(32))) * GOLDEN) >> np.uint64(53)
        of = owner[begin]
        at.append(of * WIDTH + BLOCKS[1][0] + place.astype(np.int64))
        for lag in range(1, AGAIN):
            again = (word[lag:] == word[:-lag]) & (of[lag:] == of[:-lag])
            at += [of[lag:][again] * WIDTH + SHAPES + lag] * AGAIN_WEIGHT
    every = np.concatenate([*at, np.zeros(0, np.int64)])
    return np.bincount(every, minlength=len(texts) * WIDTH).reshape(len(texts), WIDTH).astype(np.float32)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped counts times idf, every block of length one times its share."""
    x = np.array(counts, np.float32)
    for a, b, share in BLOCKS:
        part = x[:, a:b]
        part *= 1000.0 / np.maximum(part.sum(axis=1, keepdims=True), 1.0)
        np.log1p(part, out=part)
        part *= idf[a:b]
        part *= share / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
    return x


def leading(x: np.ndarray, dimensions: int, rounds: int = 6, seed: int = 1) -> np.ndarray:
    """The leading right singular vectors of ``x`` by subspace iteration: (columns, dimensions)."""
    z = np.random.default_rng(seed).normal(size=(x.shape[1], min(dimensions + 8, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        z, _ = np.linalg.qr(x.T @ (x @ z))
    _, _, turn = np.linalg.svd(x @ z, full_matrices=False)
    return (z @ turn.T)[:, :dimensions]


@dataclass
class Model:
    """idf, projection, the neighbours' vectors of length one, their labels, and the share of label 1."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    k: int
    sharpness: float

    def latent(self, counts: np.ndarray) -> np.ndarray:
        z = _weighted(counts, self.idf) @ self.projection
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray, block: int = 512) -> np.ndarray:
        """Weighted share of label 1 among the nearest; the prior where there is nothing to compare.

        Of neighbours with one cosine at the edge any may vote; equal texts have equal scores, whatever stands beside them.
        """
        out = np.full(len(counts), self.prior)
        k = min(self.k, len(self.labels))
        if not k:
            return out
        z = self.latent(counts)
        for a in range(0, len(z), block):
            cosine = z[a : a + block] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1).astype(np.float64), 0.0) ** self.sharpness
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1)
            some = (total > 0) & (counts[a : a + block].sum(axis=1) > 0)
            out[a : a + block][some] = vote[some] / total[some]
        return np.clip(out, 0.0, 1.0)


def fit(counts: np.ndarray, labels: np.ndarray, dimensions: int = 48, k: int = 15, sharpness: float = 8.0) -> Model:
    """Latent-semantic vectors of labelled term counts."""
    n = len(counts)
    idf = (np.log((1.0 + n) / (1.0 + (counts > 0).sum(axis=0))) + 1.0).astype(np.float32)
    model = Model(idf, np.zeros((WIDTH, dimensions), np.float32), np.zeros((0, dimensions), np.float32), labels, float(labels.mean()) if n else 0.5, k, sharpness)
    if n:
        model.projection = leading(_weighted(counts, idf), dimensions)
        model.vectors = model.latent(counts)
    return model


def held_out(doc_id: Column) -> Column:
    """The rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int, **how) -> Model:
    """A model from at most ``fit_rows`` labelled rows, those with the smallest hash of their id among the rows not held out."""
    own = F.col(id_col).cast("string").alias("key")
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(own).agg(F.max(label_col).cast("double").alias("label"))
    chosen = usable.orderBy(F.xxhash64("key"), "key").limit(fit_rows)
    rows = docs.select(own, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "key").groupBy("key", "label").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in pdf["text"]]
            for a, b in _slices(texts):
                found = term_counts(texts[a:b])
                yield pd.DataFrame({"key": pdf["key"].iloc[a:b].to_numpy(), "label": pdf["label"].iloc[a:b].to_numpy(), "counts": [zlib.compress(r.astype(np.float32).tobytes(), 1) for r in found]})

    got = rows.mapInPandas(count, "key string, label double, counts binary").toPandas().sort_values("key", kind="stable")
    counts = np.zeros((len(got), WIDTH), np.float32)
    for k, c in enumerate(got["counts"]):
        counts[k] = np.frombuffer(zlib.decompress(c), np.float32)
    return fit(counts, got["label"].to_numpy(np.float64), **how)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, score): every row of ``docs`` as a struct and its score, from 0 to 1; the model is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            got = [sent.value.scores(term_counts(texts[a:b])) for a, b in _slices(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(got) if got else np.zeros(0))], names=["row", "score"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    return packed.mapInArrow(run, StructType([packed.schema["row"], StructField("score", DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = 4000, **how) -> DataFrame:
    """All columns of ``docs``, held_out (boolean), score (double) and predicted (1 if score >= 0.5, else 0).

    Labels, languages, sources and ids are no inputs of a score.  Ids may have any type that has a string form; they
    meet labels by it.  Null and empty texts get the share of label 1 in the sample.  Without usable labels every score
    is 0.5.  Of several labels of an id the largest counts, of several texts the least; labels without an id or value are
    ignored; repeated rows are scored each, and a null id is not held out.  An empty table gives an empty result.  Columns
    of ``docs`` named like a result column go; all others are carried along.
    """
    model = fit_on(docs, labels, id_col, text_col, label_col, fit_rows, **how)
    row = F.col("row")
    kept = [row.getField(c).alias(c) for c in docs.columns if c.lower() not in RESULT]
    return score(docs, model, text_col).select(*kept, F.coalesce(held_out(row.getField(id_col)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
