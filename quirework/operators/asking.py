"""Concurrent calls of a translation backend from one task, with a limit, a shared pause and outcomes instead of failures."""

from __future__ import annotations

import asyncio
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from .splitting import split_long_text
from .translate import Backend, QuotaError, RateLimited, TranslationError, batches, translate_all

#: Calls in flight, where a backend names no number of its own.
LIMIT = 10


class Outcome(NamedTuple):
    result: str | None
    error_class: str | None
    message: str | None = None


class Gate:
    """What all calls of a task pass: they wait while the service has asked for a pause, and none begins once the quota
    is used up."""

    def __init__(self, backend: Backend, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.backend, self.clock, self.sleep, self.until, self.used_up = backend, clock, sleep, 0.0, False
        self.name, self.max_text_length = backend.name, backend.max_text_length

    def translate_batch(self, texts: list[str], source: str, target: str) -> list[str]:
        while not self.used_up and (left := self.until - self.clock()) > 0:
            self.sleep(left)
        if self.used_up:
            raise QuotaError("the quota is used up")
        try:
            return self.backend.translate_batch(texts, source, target)
        except RateLimited as e:
            self.until = max(self.until, self.clock() + e.seconds)
            raise
        except QuotaError:
            self.used_up = True
            raise


def limit_of(backend: Backend) -> int:
    return max(1, getattr(backend, "concurrency", None) or LIMIT)


def ask(backend: Backend, texts: list[str], source: str, target: str, size: int = 20, most_tokens: int | None = None, retries: int = 3, delay: float = 1.0, strict: bool = False, limit: int | None = None, sleep: Callable[[float], None] = time.sleep) -> list[Outcome]:
    """An outcome for each text, in order. Long texts go in parts, parts in batches; up to ``limit`` batches are in flight,
    each with its own retries and halvings. A text has the error of the first of its parts that failed."""
    gate = Gate(backend, sleep=sleep)
    most = backend.max_text_length
    parts = [split_long_text(t, most) if most else [t] for t in texts]
    size = getattr(backend, "batch_size", None) or size
    work = list(batches([p for ps in parts for p in ps], size, most_tokens))

    def one(batch: list[str]) -> list[Outcome]:
        try:
            return [Outcome(t, None) for t in translate_all(gate, batch, source, target, retries, delay, strict, sleep)]
        except Exception as e:  # a batch's error is the outcome of its texts
            return [Outcome(None, type(e).__name__, str(e))] * len(batch)

    async def all_of(pool: ThreadPoolExecutor, n: int) -> list[list[Outcome]]:
        free, loop = asyncio.Semaphore(n), asyncio.get_running_loop()

        async def held(batch: list[str]) -> list[Outcome]:
            async with free:
                return await loop.run_in_executor(pool, one, batch)

        return await asyncio.gather(*map(held, work))

    n = min(limit or limit_of(backend), max(1, len(work)))
    with ThreadPoolExecutor(n) as pool:
        found = iter([o for batch in asyncio.run(all_of(pool, n)) for o in batch])
    sep = "" if target.lower() in ("ja", "zh") else " "
    out = []
    for ps in parts:
        own = [next(found) for _ in ps]
        failed = next((o for o in own if o.error_class), None)
        out.append(failed or Outcome(sep.join(o.result for o in own), None))
    return out


def raised(outcome: Outcome) -> Exception:
    """The exception that an outcome stands for."""
    from . import translate

    return getattr(translate, outcome.error_class, TranslationError)(outcome.message)
