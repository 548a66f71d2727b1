"""Translation by a pluggable backend that runs in the tasks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import categories


class TranslationError(Exception):
    """Worth another attempt."""


class ConfigurationError(Exception):
    """Not worth another attempt."""


class QuotaError(Exception):
    """Not worth another attempt."""


class RateLimited(TranslationError):
    """The service asks for a pause of ``seconds``; worth another attempt after it."""

    def __init__(self, message: str, seconds: float = 1.0):
        super().__init__(message)
        self.seconds = seconds


class LengthMismatch(TranslationError):
    """A backend returned another number of texts than it got."""


class Backend(Protocol):
    name: str
    max_text_length: int | None

    def translate_batch(self, texts: list[str], source: str, target: str) -> list[str]:
        """As many texts, in the same order."""


class MockBackend:
    name, max_text_length = "mock", None

    def __init__(self, max_text_length: int | None = None):
        self.max_text_length = max_text_length

    def translate_batch(self, texts: list[str], source: str, target: str) -> list[str]:
        return [f"[translated]{t}" for t in texts]


def with_retries(call: Callable[[], list[str]], retries: int, delay: float, sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """Up to ``retries`` more attempts, the pause doubling; a mismatch is not retried but split."""
    for attempt in range(retries + 1):
        try:
            return call()
        except LengthMismatch:
            raise
        except TranslationError:
            if attempt == retries:
                raise
            sleep(delay * 2**attempt)
    raise AssertionError


def translate_all(backend: Backend, texts: list[str], source: str, target: str, retries: int = 3, delay: float = 1.0, strict: bool = False, sleep=time.sleep) -> list[str]:
    """Blank texts stay as they are. On a mismatch the batch is halved; a single text that still fails stays as it is,
    or raises in strict mode. Other errors of a batch that was not halved are raised."""

    def ask(batch: list[str], halved: bool) -> list[str]:
        def once() -> list[str]:
            out = backend.translate_batch(batch, source, target)
            if len(out) != len(batch):
                raise LengthMismatch(f"{len(out)} texts for {len(batch)}")
            return out

        try:
            return with_retries(once, retries, delay, sleep)
        except LengthMismatch:
            if len(batch) > 1:
                mid = len(batch) // 2
                return ask(batch[:mid], True) + ask(batch[mid:], True)
            if strict:
                raise
            return batch
        except TranslationError:
            if halved and len(batch) == 1 and not strict:
                return batch
            raise

    some = [i for i, t in enumerate(texts) if t.strip()]
    out = list(texts)
    for i, t in zip(some, ask([texts[i] for i in some], False) if some else []):
        out[i] = t
    return out


def batches(texts: list[str], size: int, most_tokens: int | None, tokens: Callable[[str], int] = len) -> Iterator[list[str]]:
    batch, weight = [], 0
    for t in texts:
        n = tokens(t)
        if batch and (len(batch) >= size or (most_tokens is not None and weight + n > most_tokens)):
            yield batch
            batch, weight = [], 0
        batch.append(t)
        weight += n
    if batch:
        yield batch


def translate_paragraphs(paragraphs: DataFrame, backend: Backend, source: str, target: str, size: int = 20, most_tokens: int | None = None, strict: bool = False, categories_: tuple[str, ...] | None = None, retries: int = 3, delay: float = 1.0, limit: int | None = None) -> DataFrame:
    """``paragraphs`` with translated_text; rows that are not translatable keep null and never reach the backend. Long
    texts go in parts, and a backend's number of batches is in flight at a time. Calls happen in the tasks, and a task
    that is run again calls again: write the result before using it twice, or use a cache (translation_cache)."""
    from . import asking

    rest = paragraphs.drop("translated_text")
    need = categories.translatable(F.col("category"), categories_) & F.col("text").isNotNull()
    schema = rest.select("*", F.lit("").alias("translated_text")).schema
    schema["translated_text"].nullable = True

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = asking.ask(backend, list(pdf["text"]), source, target, size, most_tokens, retries, delay, strict, limit)
            for o in found:
                if o.error_class:
                    raise asking.raised(o)
            yield pdf.assign(translated_text=[o.result for o in found])

    got = rest.where(need).mapInPandas(run, schema)
    return got.unionByName(rest.where(~need).withColumn("translated_text", F.lit(None).cast("string")))


def with_limit(rows: DataFrame, name: Column, limits: dict[str, int], default: int, out: str) -> DataFrame:
    """The limit of the longest prefix of ``name``; an exact name is its own longest prefix. ``limits`` is a small
    table of fixed size, so it is tested in place."""
    best = F.lit(default)
    for prefix in sorted(limits, key=len):
        best = F.when(name.startswith(prefix), limits[prefix]).otherwise(best)
    return rows.withColumn(out, best)
