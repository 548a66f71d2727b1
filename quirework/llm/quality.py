"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Words are hashed to ``WORDS`` features, and the characters a word ends with that are no letters to ``SHAPES`` more;
a word that comes again after one to ``LAGS`` words counts in one of ``SPREAD`` features of that distance. Document frequencies are counted over all documents. Labelled rows (at most ``LABELLED``, those of least hashed id)
give a tf-idf matrix whose singular value decomposition spans the latent space. Their vectors, of fixed number and
size, are sent to every executor; each document takes its exact cosine to all of them, in blocks, and its
``NEIGHBOURS`` most similar ones vote with their similarity as weight.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import table

WORDS, SHAPES, LAGS, SPREAD = 3776, 256, 4, 16
SIZE = WORDS + SHAPES + LAGS * SPREAD
LABELLED, DIMS, NEIGHBOURS, BLOCK = 4096, 48, 25, 256
CUT = 0.3


class WordFeatures(dict):
    """Word -> word feature * SHAPES + shape feature; holds at most ``most`` words."""

    def __init__(self, most: int = 150_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        end = len(word)
        while end and not (97 <= word[end - 1] <= 122 or word[end - 1] > 127):
            end -= 1
        f = (zlib.crc32(word) % WORDS) * SHAPES + zlib.crc32(word[end:] or (b"#" if not end else b"")) % SHAPES
        if len(word) <= 64:
            self[word] = f
        return f

    def counts(self, text: str | None, out: np.ndarray) -> None:
        """Adds the text's features to ``out``, of SIZE."""
        if not text:
            return
        if len(self) > self.most:
            self.clear()
        words = text.encode().lower().split()
        f = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        out[:WORDS] += np.bincount(f // SHAPES, minlength=WORDS)
        out[WORDS : WORDS + SHAPES] += np.bincount(f % SHAPES, minlength=SHAPES)
        for lag in range(1, LAGS + 1):
            again = np.flatnonzero(f[lag:] == f[:-lag])
            if len(again):
                at = WORDS + SHAPES + (lag - 1) * SPREAD
                out[at : at + SPREAD] += np.bincount(again % SPREAD, minlength=SPREAD)


_words = WordFeatures()


def blocks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows with their feature counts, BLOCK rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            b = batch.slice(at, BLOCK)
            x = np.zeros((b.num_rows, SIZE), np.float32)
            for row, text in zip(x, b.column(text_at)):
                _words.counts(text.as_py(), row)
            yield b, x


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def embed(self, x: np.ndarray) -> np.ndarray:
        v = (np.log1p(x) * self.idf) @ self.axes
        length = np.sqrt((v * v).sum(1, keepdims=True))
        return v / np.where(length > 0, length, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """A row without features, or without a neighbour of positive similarity, gets the share of label 1."""
        out = np.full(len(x), self.prior)
        if not len(self.labels):
            return out
        cos = self.embed(x) @ self.vectors.T
        k = min(NEIGHBOURS, cos.shape[1])
        best = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cos, best, 1), 0).astype(np.float64)
        total = weight.sum(1)
        return np.where(total > 0, (weight * self.labels[best]).sum(1) / np.where(total > 0, total, 1), out).clip(0, 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """(documents, documents that have each feature), over all rows; SIZE numbers a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(SIZE, np.int64)
        for b, x in blocks(batches, 0):
            n, df = n + b.num_rows, df + (x > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE + 1)), pa.array(np.append(df, n))], names=["f", "n"])

    found = docs.select("text").mapInArrow(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SIZE + 1, np.int64)
    for r in found:
        out[r.f] = r.n
    return int(out[SIZE]), out[:SIZE]


def labelled_counts(docs: DataFrame, labels: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature counts and labels of the ``most`` labelled documents of least hashed id, outside the held-out fifth. Of
    rows that share an id, the one of least text counts; of its labels, the least."""
    ids = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # at most ``most`` rows from here on

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in blocks(batches, 1):
            at = [np.flatnonzero(r).astype("<u2") for r in x]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([r[a].tobytes() for a, r in zip(at, x)], pa.binary())], names=["doc_id", "y", "at", "n"]
            )

    got = sorted(rows.select("doc_id", "text", "quality").mapInArrow(sparse, "doc_id long, y int, at binary, n binary").collect(), key=lambda r: r.doc_id)
    x = np.zeros((len(got), SIZE), np.float32)
    for row, r in zip(x, got):
        row[np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["n"], np.float32)
    return x, np.array([r.y for r in got], np.float64)


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model:
    n, df = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32)
    x, y = labelled_counts(docs, labels, most)
    if not len(y):
        return Model(idf, np.zeros((SIZE, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    tfidf = np.log1p(x) * idf
    tfidf /= np.maximum(np.sqrt((tfidf * tfidf).sum(1, keepdims=True)), 1e-9)
    q = np.random.default_rng(0).standard_normal((SIZE, DIMS + 16)).astype(np.float32)
    for _ in range(6):  # subspace iteration to the leading right singular vectors
        q, _ = np.linalg.qr(tfidf.T @ (tfidf @ q))
    _, _, vt = np.linalg.svd(tfidf @ q, full_matrices=False)
    model = Model(idf, (q @ vt.T)[:, :DIMS].copy(), np.zeros((0, DIMS), np.float32), y, float(y.mean()))
    model.vectors = model.embed(x)
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted; one row for each row of ``docs``.

    The score is 0 to 1, higher where label 1 is likelier. Null, empty and featureless texts score the share of label 1
    among the labelled rows (0.5 if there are none). Texts are read whole. Repeated rows score alike, a null doc_id is
    not held out, other columns are not read, and an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in blocks(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.score(x))], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for b, x in blocks([batch], at):
                yield b.filter(pa.array(sent.value.score(x) >= CUT))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
