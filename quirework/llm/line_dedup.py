"""Line deduplication over levelled sorted runs of line hashes. DataFrame operations only.

A run is a table of line keys: two 64-bit hashes of the key, how many documents hold it and the largest id among those
documents. It is bucketed by the hashes and sorted within each bucket, and all runs have the same buckets, so runs are
joined and compacted bucket by bucket, as they lie, without a shuffle or a sort. A batch of documents is
merge-anti-joined to the runs there are: keys that no run has are new and bring their holder, keys that some run has
only add to its count. The batch's own run goes to level 0; when a level holds ``fanout`` runs, they are merged into one
run of the next level. Batches arrive in descending order of document id, cut at its quantiles, so the first holder of a
key is the largest id that holds it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, settings, table

SPACE = " \t\n\x0b\f\r"
MIN_CHARS, MIN_DOCS = 20, 3
BATCHES, FANOUT = 4, 2
#: Keys of a bucket, about; most buckets of a run; frequent keys that are broadcast (under 64 MB), beyond it they are joined by a shuffle.
BUCKET, MOST_BUCKETS, BROADCAST_KEYS = 250_000, 20_000, 1 << 20
KEY = ["h1", "h2"]
#: A bucket is one file here, so that its order is known to the reader.
ORDERED = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


def line_key(line: Column) -> Column:
    """The line without white space [\\x20\\x09-\\x0D] at its ends, A-Z lower-cased and nothing else."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def key_hash(key: Column) -> Column:
    """128 bits: equal hashes are taken as equal keys."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, body, pos, h1, h2): a row for each line whose key has at least ``min_chars`` code points; ``body`` is the
    text's hash, which tells documents apart that share an id."""
    hashed = docs.select("doc_id", F.xxhash64("text").alias("body"), "text")  # before the lines are exploded: no line's row has the text
    keys = hashed.select("doc_id", "body", F.posexplode(F.transform(F.split("text", "\n"), line_key)).alias("pos", "key"))
    return keys.where(F.length("key") >= min_chars).select("doc_id", "body", "pos", key_hash(F.col("key")).alias("k")).select("doc_id", "body", "pos", "k.h1", "k.h2")


class LineRuns:
    """The runs, each a table bucketed by key under the workspace, one sorted file a bucket.

    The session's catalog must be able to hold bucketed tables; they leave it with :meth:`close`, or the ``with`` block,
    also after a failure."""

    def __init__(self, ws: Workspace, fanout: int = FANOUT, buckets: int = 8):
        self.ws, self.fanout, self.buckets, self.levels, self.made, self.tables = ws, fanout, buckets, {}, 0, []

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _put(self, rows: DataFrame) -> str:
        """Writes a run. Rows must come in one partition a bucket: from a join of runs, or from :meth:`_dealt`."""
        self.made += 1
        name = f"run_{self.ws.root.rpartition('-')[2]}_{self.made}"
        self.tables.append(name)
        with settings(self.ws.spark, ORDERED):
            rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet").option("path", self.ws.path(name)).saveAsTable(name)
        return name

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` in one partition a bucket. An aggregate by key is dealt so already where it shuffles to as many partitions."""
        return rows.repartition(self.buckets, *KEY)

    def _drop(self, name: str) -> None:
        self.ws.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.ws.drop(name)
        self.tables.remove(name)

    def runs(self) -> list[str]:
        return [r for level in sorted(self.levels) for r in self.levels[level]]

    def _table(self, name: str) -> DataFrame:
        return self.ws.spark.table(name)

    @staticmethod
    def _merged(one: DataFrame, two: DataFrame) -> DataFrame:
        """A merge of two sorted runs: counts are added, the larger holder stays."""
        two = two.withColumnRenamed("n_docs", "more").withColumnRenamed("holder", "other")
        both = one.join(two.hint("merge"), KEY, "full")
        return both.select(*KEY, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("holder", "other").alias("holder"))

    def anti(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose key is in no run."""
        for name in self.runs():
            keys = keys.join(self._table(name).select(*KEY).hint("merge"), KEY, "left_anti")
        return keys

    def add(self, batch: DataFrame) -> None:
        """``batch``: (doc_id, h1, h2). Adds its run, and compacts every level that is full. Keys are made unique in each
        document and counted by key, both map-side first."""
        own = batch.groupBy(*KEY, "doc_id").agg(F.lit(1).alias("one")).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("holder"))
        with settings(self.ws.spark, {"spark.sql.shuffle.partitions": str(self.buckets), "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
            made = self._put(self._dealt(own))
        if self.levels:
            with settings(self.ws.spark, ORDERED):
                own = self._table(made)
                new = self.anti(own.select(*KEY)).select(*KEY, F.lit(True).alias("new"))
                whole = own.join(new.hint("merge"), KEY, "left")
                plain, made = made, self._put(whole.select(*KEY, "n_docs", F.when(F.col("new"), F.col("holder")).alias("holder")))
            self._drop(plain)
        self.levels.setdefault(0, []).append(made)
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            self.levels.setdefault(level + 1, []).append(self._compact(self.levels.pop(level)))
            level += 1

    def _compact(self, names: list[str]) -> str:
        while len(names) > 1:
            with settings(self.ws.spark, ORDERED):
                made = self._put(self._merged(self._table(names[0]), self._table(names[1])))
            for name in names[:2]:
                self._drop(name)
            names = [made, *names[2:]]
        return names[0]

    def frequent(self, min_docs: int) -> DataFrame:
        """Keys that at least ``min_docs`` documents hold, with the document that keeps its lines. All runs become one."""
        last = self._compact(self.runs())
        self.levels = {max(self.levels): [last]}
        return self.ws.put("frequent", self._table(last).where(F.col("n_docs") >= min_docs).select(*KEY, "holder"))

    def close(self) -> None:
        for name in list(self.tables):
            self._drop(name)
        self.levels = {}


def dedup_lines(docs: DataFrame, ws: Workspace, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """``docs`` with ``text`` reduced to the lines that stay, and ``n_lines``, ``n_dropped``.

    Lines whose key has ``min_chars`` code points and is held by ``min_docs`` documents go, except in the largest doc_id
    that holds the key. A null or empty text is one empty line. A document that loses every line has the empty text.
    Rows that share a doc_id are one document when holders are counted; each of them keeps what their doc_id holds. A
    null doc_id is less than any other; doc_id must be a whole number. Other columns pass unchanged, whatever their
    names, but n_lines and n_dropped are replaced. An empty table gives an empty table. A line that a third of all
    documents holds is counted map-side before any shuffle by its key; frequent keys are broadcast, or, beyond
    BROADCAST_KEYS, joined by a plain shuffled join, whose skewed partitions Spark splits at run time. Work and memory
    are linear in a document's lines."""
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))  # nulls as the least
    plain = docs.select(id_.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keys = ws.put("keys", line_keys(plain, min_chars))
    size = keys.count()
    cuts = keys.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else []
    edges = [None, *sorted(set(cuts or []), reverse=True), None]
    with LineRuns(ws, buckets=min(MOST_BUCKETS, max(1, -(-size // BUCKET)))) as runs:
        for above, below in zip(edges, edges[1:]):
            part = keys
            if above is not None:
                part = part.where(F.col("doc_id") <= above)
            if below is not None:
                part = part.where(F.col("doc_id") > below)
            runs.add(part.select("doc_id", *KEY))
        frequent = runs.frequent(min_docs)
    found = keys.join(F.broadcast(frequent) if frequent.count() <= BROADCAST_KEYS else frequent.hint("merge"), KEY).where("doc_id <> holder")
    at = F.array_sort(F.collect_set("pos"))
    drops = ws.put("drops", found.groupBy("doc_id", "body").agg(at.alias("drops")))
    ws.drop("keys", "frequent")
    text = F.coalesce("text", F.lit(""))
    rest = docs.drop("n_lines", "n_dropped")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest.columns]).alias("row"), id_.alias("doc_id"), F.xxhash64(text).alias("body"))
    joined = rows.join(drops, ["doc_id", "body"], "left").withColumn("lines", F.split(F.coalesce("row.text", F.lit("")), "\n"))
    # the positions to drop, spread into a flag for each line: false up to a position, true there
    before = F.concat(F.array(F.lit(-1)), F.slice("drops", F.lit(1), F.size("drops") - 1))
    spread = F.flatten(F.zip_with("drops", before, lambda d, b: F.concat(F.array_repeat(F.lit(False), d - b - 1), F.array(F.lit(True)))))
    flags = F.concat(spread, F.array_repeat(F.lit(False), F.size("lines") - 1 - F.element_at("drops", -1)))
    kept = F.array_compact(F.zip_with("lines", flags, lambda line, gone: F.when(~gone, line)))
    return joined.select(
        *[F.when(F.col("drops").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else F.col(f"row.`{c}`") for c in rest.columns],
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), Workspace(spark, "op9"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT r, doc_id, id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d)),
f AS (SELECT k, max(id) AS holder FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT id) >= 3),
m AS (SELECT l.*, f.k IS NOT NULL AND l.id <> f.holder AS dropped FROM l LEFT JOIN f ON l.k = f.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY r
"""
