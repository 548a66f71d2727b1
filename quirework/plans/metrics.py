"""Counts, progress and errors of the stages of a run, seen while their tables are written."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

Progress = Callable[[str, int, int], None]


class PipelineError(Exception):
    """An error of a stage, or of the action that ran its tasks."""

    def __init__(self, stage: str, cause: Exception):
        super().__init__(f"{stage}: {cause}")
        self.stage = stage


class Stages:
    """``counts`` has, by stage, what was observed as the stage's rows went by: nothing is scanned for it."""

    def __init__(self, spark: SparkSession, progress: Progress | None = None, every: float = 0.2):
        self.spark, self.progress, self.every, self._seen = spark, progress, every, {}

    def observe(self, stage: str, df: DataFrame, **what: Column) -> DataFrame:
        self._seen[stage] = Observation(f"{stage}-{uuid.uuid4().hex[:8]}")
        return df.observe(self._seen[stage], *[c.alias(n) for n, c in what.items()])

    @property
    def counts(self) -> dict[str, dict]:
        """Of the stages whose tables have been written; waits for none that has not run."""
        return {s: o.get for s, o in self._seen.items() if o._jo is not None and o._jo.future().isCompleted()}

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        """Errors within are of this stage, and ``progress`` hears of the tasks that are done, and how many there are so far."""
        group, done = f"{name}-{uuid.uuid4().hex[:8]}", threading.Event()
        context = self.spark.sparkContext
        old = context.getLocalProperty("spark.jobGroup.id")
        context.setLocalProperty("spark.jobGroup.id", group)
        watcher = threading.Thread(target=self._watch, args=(name, group, done), daemon=True) if self.progress else None
        if watcher:
            watcher.start()
        try:
            yield
        except PipelineError:
            raise
        except Exception as e:
            raise PipelineError(name, e) from e
        finally:
            done.set()
            if watcher:
                watcher.join()
            context.setLocalProperty("spark.jobGroup.id", old)

    def _watch(self, name: str, group: str, done: threading.Event) -> None:
        tracker, last = self.spark.sparkContext.statusTracker(), None
        while True:
            ended = done.wait(self.every)
            some = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) if (job := tracker.getJobInfo(j)) for s in job.stageIds]
            now = (sum(s.numCompletedTasks for s in some if s), sum(s.numTasks for s in some if s))
            if now != last and now[1]:
                last = now
                self.progress(name, *now)
            if ended:
                return
