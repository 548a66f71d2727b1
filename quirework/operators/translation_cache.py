"""Translations that survive a second run: a table of answers by content, and only what it lacks is asked for.

A row of the table is one question: the key (a SHA-256 of backend, languages and text), its result or the class of its
error, and the run that asked. A text has its answer once some row has a result; until then each run asks again, so
only what failed. Texts are made distinct before they are asked, and a task holds as many as it asks for at a time, so that a
run that is killed loses no more than the calls in flight: finished tasks' files stay (commit algorithm 2). Speculation
should be off, as it would ask twice."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from . import asking, categories
from .translate import Backend

ROWS = "key string, result string, error_class string, message string, run string"
#: Tasks of one job; more texts go in several jobs.
TASKS = 10_000


def text_key(backend: str, source: str, target: str, text: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(backend), F.lit(source.lower()), F.lit(target.lower()), text), 256)


class TranslationCache:
    """The table of answers at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """Every question that was asked (ROWS); none before the first run."""
        if not scratch.exists(self.spark, self.path):
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).parquet(self.path)

    def answers(self) -> DataFrame:
        """(key, result): one row a text that has an answer."""
        return self.rows().where("result IS NOT NULL").groupBy("key").agg(F.min("result").alias("result"))

    def outcomes(self) -> DataFrame:
        """(key, result, error_class, asked): error_class is null where there is a result, else that of a last question."""
        last = F.max_by("error_class", F.struct(F.col("run"), F.coalesce("error_class", F.lit(""))))
        found = self.rows().groupBy("key").agg(F.min("result").alias("result"), last.alias("failed"), F.count(F.lit(1)).alias("asked"))
        return found.select("key", "result", F.when(F.col("result").isNull(), F.col("failed")).alias("error_class"), "asked")

    def ask(self, texts: DataFrame, backend: Backend, source: str, target: str, run: str, size: int = 20, tasks: int = TASKS, **how) -> None:
        """Asks for the texts (column ``text``) that have no answer yet, each once, and adds the outcomes.

        ``run`` names the run; ``how`` goes to :func:`asking.ask`. Null texts are left out."""

        def calls(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                found = asking.ask(backend, b.column(1).to_pylist(), source, target, size, **how)
                cols = [pa.array([getattr(o, f) for o in found], pa.string()) for f in ("result", "error_class", "message")]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array([run] * len(found), pa.string())], names=["key", "result", "error_class", "message", "run"])

        wanted = texts.where("text IS NOT NULL").select(text_key(backend.name, source, target, F.col("text")).alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
        missing = lambda: wanted.join(self.answers().select("key"), "key", "left_anti")
        each = size * asking.limit_of(backend)
        jobs = max(1, -(-missing().count() // (each * tasks)))
        for job in range(jobs):
            rows = missing().where(F.pmod(F.xxhash64("key"), F.lit(jobs)) == job)
            n = rows.count()
            if n:
                asked = rows.repartition(max(1, -(-n // each)), "key").mapInArrow(calls, ROWS)
                asked.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(self.path)


def translate_cached(paragraphs: DataFrame, backend: Backend, source: str, target: str, cache: TranslationCache, run: str, size: int = 20, strict: bool = False, categories_: tuple[str, ...] | None = None, **how) -> DataFrame:
    """``paragraphs`` with translated_text and error_class, which is null for a text that is translated or needs none.

    With ``strict``, a text that failed is an error once the run is over; all answers stay in the cache."""
    need = categories.translatable(F.col("category"), categories_) & F.col("text").isNotNull()
    cache.ask(paragraphs.where(need).select("text"), backend, source, target, run, size, **how)
    rest = paragraphs.drop("translated_text", "error_class")
    keyed = rest.withColumn("__key", F.when(need, text_key(backend.name, source, target, F.col("text"))))
    found = cache.outcomes().select(F.col("key").alias("__key"), F.col("result").alias("translated_text"), "error_class")
    out = keyed.join(found, "__key", "left").select(*[F.col(f"`{c}`") for c in rest.columns], "translated_text", "error_class")
    if strict:
        failed = cache.outcomes().where("error_class IS NOT NULL").join(keyed.select(F.col("__key").alias("key")), "key", "left_semi").first()
        if failed:
            raise asking.raised(asking.Outcome(None, failed.error_class, f"a text is not translated: {failed.error_class}"))
    return out
