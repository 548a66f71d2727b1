"""Layout detection by a pluggable model that runs in the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, page_number int, boxes array<struct<label: string, score: double, coordinate: array<double>>>"


class LayoutModel(Protocol):
    def detect(self, image: bytes) -> list[dict]:
        """label, score and coordinate (x0, y0, x1, y1 in pixels) of each box."""


def analyse(pages: DataFrame, load: Callable[[], LayoutModel]) -> DataFrame:
    """Detections (:data:`SCHEMA`) of pages (doc_id, page_number, image). The model is loaded once a task, in the task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in frames:
            model = model or load()
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "page_number": pdf["page_number"], "boxes": [model.detect(x) for x in pdf["image"]]})

    return pages.select("doc_id", "page_number", "image").mapInPandas(run, SCHEMA)
