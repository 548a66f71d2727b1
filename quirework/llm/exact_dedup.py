"""Exact deduplication by a streaming query with disk-backed keyed state.

The stream reads the documents' files and groups them by the digest of the whole text. Its state, in RocksDB without
expiry, holds for each digest how many rows had it, the largest identifier among them and where that row's text lies
(path of the file and row number). More files can arrive later: the same state goes on. Rows that hit a digest with other rows
are then checked byte by byte against the text at that place; should a digest ever stand for different texts, these are
regrouped by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, settings

#: Files are read in micro-batches of this many bytes at most.
BATCH_BYTES = 256 << 30
#: Digests that are broadcast: at most so many, of 32 bytes each; beyond it they are joined by a shuffle.
BROADCAST_DIGESTS = 200_000
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _rows(df: DataFrame, normalise: Callable[[Column], Column], digest: Callable[[Column], Column], text: bool = False) -> DataFrame:
    body = normalise(F.coalesce(F.col("text"), F.lit("")))
    where = F.struct(F.col("doc_id").alias("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    out = df.select(where.alias("spot"), body.alias("body"))
    return out.select("spot", digest(F.col("body")).alias("digest"), *["body"] * text)


def _stream_path(spark: SparkSession, path: str) -> str:
    """A stream reads a folder, or whatever a pattern fits: a single file becomes a pattern that fits only it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    return f"{path[:-1]}[{path[-1]}]" if single else path


class DedupStream:
    """The state of all documents seen so far, kept under ``ws``."""

    def __init__(self, spark: SparkSession, ws: Workspace, normalise: Callable[[Column], Column] = lambda t: t, digest: Callable[[Column], Column] = sha256):
        self.spark, self.ws, self.normalise, self.digest = spark, ws, normalise, digest

    def advance(self, path: str, batch_bytes: int = BATCH_BYTES, files: int | None = None) -> None:
        """Takes in the files at ``path`` that the state has not seen, and ends when there are no more."""
        schema = self.spark.read.parquet(path).schema
        with settings(self.spark, ROCKSDB):
            reader = self.spark.readStream.schema(schema)
            reader = reader.option("maxFilesPerTrigger", files) if files else reader.option("maxBytesPerTrigger", batch_bytes)
            seen = _rows(reader.parquet(_stream_path(self.spark, path)), self.normalise, self.digest)
            state = seen.groupBy("digest").agg(F.max("spot").alias("keep"), F.count(F.lit(1)).alias("group_size"))
            query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", self.ws.path("state")).trigger(availableNow=True).start()
            query.awaitTermination()

    def state(self) -> DataFrame:
        """digest, keep (doc_id, file, row), group_size."""
        with settings(self.spark, ROCKSDB):
            rows = self.spark.read.format("statestore").load(self.ws.path("state")).select(F.col("key.*"), F.col("value.*"))
            digest, keep, size = rows.columns
            rows = rows.select(F.col(f"`{digest}`").alias("digest"), F.col(f"`{keep}`").alias("keep"), F.col(f"`{size}`").alias("group_size"))
            return self.ws.put("groups", rows)

    def resolve(self, path: str) -> DataFrame:
        """A row for each document of ``path``: doc_id, keep_id, group_size, kept, digest."""
        docs = self.spark.read.parquet(path)
        groups = self.state()
        placed = self.ws.put("placed", _rows(docs, self.normalise, self.digest).join(groups, "digest", "left"))
        repeated = self.ws.put("repeated", groups.where("group_size > 1").select("digest", "keep"))
        few = repeated.count() <= BROADCAST_DIGESTS
        texts = _rows(docs, self.normalise, self.digest, text=True)
        hits = self.ws.put("hits", texts.join(F.broadcast(repeated) if few else repeated, "digest"))
        keepers = hits.where(F.col("spot") == F.col("keep")).select("digest", F.col("body").alias("kept_body"))
        # both sides are read from tables and nothing is grouped behind the join, so Spark can split the partition of a
        # digest that many rows share
        wrong = hits.join(keepers.hint("merge"), "digest").where(F.col("body") != F.col("kept_body")).select("digest")
        wrong = self.ws.put("wrong", wrong)
        good = placed.select("spot", "keep", "group_size", "digest")
        if not wrong.isEmpty():
            clash = hits.join(wrong, "digest", "left_semi").select("spot", "digest", "body")
            own = clash.groupBy("digest", "body").agg(F.max("spot").alias("keep"), F.count(F.lit(1)).alias("group_size"))
            again = clash.join(own, ["digest", "body"]).select("spot", "keep", "group_size", "digest")
            good = good.join(wrong, "digest", "left_anti").select("spot", "keep", "group_size", "digest").unionByName(again)
        return good.select(
            F.col("spot.doc_id").alias("doc_id"), F.col("keep.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
            F.col("spot").eqNullSafe(F.col("keep")).alias("kept"), "digest",
        )


def exact_dedup(spark: SparkSession, path: str, ws: Workspace, **how) -> DataFrame:
    """Which of the documents in the Parquet files at ``path`` stay: of equal texts, the row with the largest doc_id.

    doc_id, keep_id, group_size, kept, digest; one row per row of the input. Null text counts as empty. Rows that share
    text and doc_id are one group in which the row latest by file path and row number stays. A null doc_id is less than
    any other. Other columns are not read. An empty table gives no rows. Texts of any length are digested whole."""
    stream = DedupStream(spark, ws, **how)
    stream.advance(path)
    return stream.resolve(path)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark, f"{sf_dir.rstrip('/')}/documents.parquet", Workspace(spark, "op5"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size, row_number() OVER w = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)
WINDOW w AS (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST, r DESC)
"""
