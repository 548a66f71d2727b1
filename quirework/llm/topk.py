"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of fixed size, each block against all rows. A pass scores everything and counts scores in a
histogram for each query; the global histogram tells in which bucket the kth highest score lies; the next pass looks
into that bucket with finer ones, until buckets are one score wide. A last pass returns the rows at or above each kth
score; among equals, the smaller identifiers. Within a task, only buckets from the top down to its own kth row are
counted: the global kth score can't lie below them. So a task sends at most k rows a query, whatever it has read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .workspace import Workspace, table

K, SCALE, EVERY = 5, 256, 50
#: Queries in a block (with vectors of 64 numbers 4 MB), buckets of a histogram, candidates scored at a time.
BLOCK, BUCKETS, STEP = 8192, 1024, 512
SLICE = 2048
FOUND = "key long, query_id long, vec_id long, score long"


def quantise(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as long; null if the vector is null or has a null or non-finite component."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, vectors), at most STEP rows of one dimension at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            b = batch.slice(at, STEP)
            ids, column = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                take = (ends[rows] - d)[:, None] + np.arange(d)
                yield int(d), ids[rows], flat[take].reshape(len(rows), d)


class Block:
    """Queries of one block: keys of the query rows, ids and vectors by dimension. Rows are numbered over all dimensions."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, vectors: list[np.ndarray]):
        sizes = np.array([len(v) for v in vectors])
        order = np.argsort(sizes, kind="stable")
        self.keys, self.ids, self.by = keys[order], ids[order], {}
        for d in np.unique(sizes):
            rows = np.flatnonzero(sizes[order] == d)
            self.by[int(d)] = (int(rows[0]), np.stack([vectors[i] for i in order[rows]]).astype(np.float64).reshape(len(rows), int(d)))

    def scores(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first query, candidate ids, scores): queries by candidates; -1e300 where a query meets itself."""
        for d, ids, vectors in _matrices(batches):
            if d in self.by:
                first, q = self.by[d]
                for at in range(0, len(q), SLICE):
                    s = q[at : at + SLICE] @ vectors.T
                    own = self.ids[first + at : first + at + len(s)]
                    s[own[:, None] == ids[None, :]] = -1e300
                    yield first + at, ids, s


def _histogram(block: Block, low: np.ndarray, width: np.ndarray, k: int):
    """A pass: for each query, how many scores lie in each of its buckets, from the top to the task's kth row. Scores
    at or above the last bucket's end count in a bucket of their own, those below ``low`` in none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(block.ids)
        top = np.full((n, 0), -np.inf)  # the k highest so far by query, as buckets
        cut = low - 1.0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def settle() -> None:
            nonlocal top, size, held
            if not held:
                return
            q, b = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((-b, q))
            q, b = q[order], b[order]
            starts = np.searchsorted(q, np.arange(n + 1))
            rank = np.arange(len(q)) - starts[q]
            keep = rank < k
            held = [(q[keep], b[keep])]
            size = int(keep.sum())
            kth = rank == k - 1
            cut[q[kth]] = np.maximum(low[q[kth]], low[q[kth]] + b[kth] * width[q[kth]])

        for first, ids, s in block.scores(batches):
            c = cut[first : first + len(s)]
            q, j = np.nonzero((s >= c[:, None]) & (s >= low[first : first + len(s), None]))
            if len(q):
                v = s[q, j]
                q = q + first
                held.append((q, np.minimum((v - low[q]) // width[q], BUCKETS).astype(np.int64)))
                size += len(q)
                if size > 4 * k * n + 100_000:
                    settle()
        settle()
        if held:
            q, b = held[0]
            keys, counts = np.unique(q * (BUCKETS + 1) + b, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys // (BUCKETS + 1)), pa.array(keys % (BUCKETS + 1)), pa.array(counts)], names=["q", "b", "n"])

    return run


def _at_least(block: Block, least: np.ndarray, k: int):
    """The last pass: for each query, the task's k best rows with a score of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, n = 0, len(block.ids)

        def settle() -> None:
            nonlocal held, size
            if held:
                q, ids, v = (np.concatenate(x) for x in zip(*held))
                order = np.lexsort((ids, -v, q))
                q, ids, v = q[order], ids[order], v[order]
                keep = np.arange(len(q)) - np.searchsorted(q, np.arange(n + 1))[q] < k
                held = [(q[keep], ids[keep], v[keep])]
                size = int(keep.sum())

        for first, ids, s in block.scores(batches):
            q, j = np.nonzero(s >= least[first : first + len(s), None])
            if len(q):
                held.append((q + first, ids[j], s[q, j]))
                size += len(q)
                if size > 4 * k * n + 100_000:
                    settle()
        settle()
        if held:
            q, ids, v = held[0]
            yield pa.RecordBatch.from_arrays([pa.array(block.keys[q]), pa.array(block.ids[q]), pa.array(ids), pa.array(v.astype(np.int64))], names=["key", "query_id", "vec_id", "score"])

    return run


def _search_block(rows: DataFrame, block: Block, reach: float, k: int) -> DataFrame:
    n = len(block.ids)
    low, span = np.full(n, -reach), np.full(n, 2 * reach + 1)
    above = np.zeros(n, np.int64)  # rows above the bucket that is looked into
    while True:
        width = np.maximum(1.0, np.ceil(span / BUCKETS))
        found = rows.mapInArrow(_histogram(block, low, width, k), "q long, b long, n long").groupBy("q", "b").agg(F.sum("n").alias("n"))
        below = W.partitionBy("q").orderBy(F.desc("b"))
        ranked = found.withColumn("upto", F.sum("n").over(below)).where(F.col("upto") - F.col("n") < k)
        kth = ranked.groupBy("q").agg(F.min("b").alias("b"), F.max("upto").alias("upto"))
        for r in kth.collect():  # a row for each query of the block
            low[r.q] = low[r.q] + r.b * width[r.q] if r.upto >= k else low[r.q]
            above[r.q] = r.upto
        span = np.where(above >= k, width, span)
        short = above < k  # fewer than k rows in all: everything counts
        low[short] = -reach
        if (short | (width == 1)).all():
            return rows.mapInArrow(_at_least(block, low, k), FOUND)


def top_k(rows: DataFrame, queries: DataFrame, ws: Workspace, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest inner products over ``rows``, ties to smaller vec_id.

    ``rows`` and ``queries``: vec_id long and vector, an array of whole numbers as doubles; null vectors take no part. A
    query is scored against all rows but those of its own vec_id and those of another dimension. A query with fewer than
    ``k`` such rows gets all of them, one with none has no row in the result; repeated rows of a vec_id count each, and
    each of several query rows that share a vec_id has ranks of its own. Other columns are not read. Inner products must
    stay below 2**53, where doubles are exact: longer vectors raise ValueError. An empty table gives no rows."""
    rows, queries = (df.select(F.col("vec_id").cast("long"), "vector").where("vec_id IS NOT NULL AND vector IS NOT NULL") for df in (rows, queries))
    rows = ws.put("rows", rows)
    queries = ws.put("queries", queries.withColumn("key", F.monotonically_increasing_id()))
    reach = rows.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    longest = queries.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    if reach is None or longest is None:
        return ws.spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    reach = max(reach, longest)
    if reach >= 1 << 53:
        raise ValueError("inner products of these vectors may reach 2**53")
    last, at = -1, 0
    while got := queries.where(F.col("key") > last).orderBy("key").limit(block).collect():  # at most a block
        last = got[-1].key
        made = Block(np.array([r.key for r in got]), np.array([r.vec_id for r in got]), [np.array(r.vector) for r in got])
        ws.put(f"found/block={at}", _search_block(rows, made, float(reach), k))
        at += 1
    found = ws.spark.read.schema(FOUND).parquet(ws.path("found"))
    order = W.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", quantise(F.col("embedding")).alias("vector"))
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0), Workspace(spark, "op2"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.e, r.e) AS BIGINT) AS score
      FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.e) = len(r.e) WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 5
"""
