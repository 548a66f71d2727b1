"""Splitting long texts at sentence ends, and joining their translated parts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_END = re.compile(r"[.!?。！？]\s*")


def split_long_text(text: str, most: int) -> list[str]:
    """Parts of at most ``most`` characters whose concatenation is ``text``: cut after the last sentence end in reach,
    else after the last blank in the second half, else hard."""
    parts, at = [], 0
    while len(text) - at > most:
        window = text[at : at + most]
        cut = 0
        for m in _END.finditer(window):
            cut = m.end()
        if not cut:
            blank = window.rfind(" ")
            cut = blank + 1 if blank > most // 2 else most
        parts.append(text[at : at + cut])
        at += cut
    return parts + [text[at:]] if at < len(text) or not parts else parts


def split_texts(df: DataFrame, key: str, most: int | None) -> DataFrame:
    """(key, part_no, part, parts) of column ``text``. Short texts, and all without a limit, are one part."""
    if most is None:
        return df.select(key, F.lit(0).alias("part_no"), F.col("text").alias("part"), F.lit(1).alias("parts"))
    short, long = df.where(F.length("text") <= most), df.where(F.length("text") > most).select(key, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [split_long_text(t, most) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made)], names=[key, "made"])

    cut = long.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, made array<string>")
    rows = cut.select(key, F.posexplode("made").alias("part_no", "part"), F.size("made").alias("parts"))
    return short.select(key, F.lit(0).alias("part_no"), F.col("text").alias("part"), F.lit(1).alias("parts")).unionByName(rows)


def rejoin(parts: DataFrame, key: str, target_lang: str) -> DataFrame:
    """(key, text): no blank between parts in Japanese and Chinese."""
    sep = "" if target_lang.lower() in ("ja", "zh") else " "
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part_no", "part"))), lambda x: x["part"])
    return parts.groupBy(key).agg(F.array_join(ordered, sep).alias("text"))
