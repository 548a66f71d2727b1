"""Chunks of a document's texts for a translator: by number, by tokens, by bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import folds


def by_number(df: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return df.withColumn("chunk", F.floor(n / size).cast("int"))


def by_weight(df: DataFrame, keys: list[str], order: str, weight: str, most: int, count: int) -> DataFrame:
    """(keys, order, chunk). A chunk ends before the row that would be one too many or too heavy; a row heavier than
    ``most`` is a chunk of its own. A fold, as the sum starts anew with each chunk; linear in a group's rows."""
    arr = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.expr(weight).cast("bigint").alias("w")))).alias("ws"))
    over = f"s.n > 0 AND (s.n >= {count} OR s.w + e.w > {most})"
    step = f"""named_struct('c', CASE WHEN {over} THEN s.c + 1 ELSE s.c END, 'n', CASE WHEN {over} THEN 1 ELSE s.n + 1 END, 'w', CASE WHEN {over} THEN e.w ELSE s.w + e.w END,
      'out', concat(s.out, array(CASE WHEN {over} THEN s.c + 1 ELSE s.c END)))"""
    fold = f"aggregate(ws, named_struct('c', 0, 'n', 0, 'w', 0L, 'out', CAST(array() AS ARRAY<INT>)), (s, e) -> {step}, s -> s.out)"
    chunk = folds.routed(F.expr(fold), F.size("ws"), folds.chunks(most, count), F.transform("ws", lambda x: x["w"]))
    return arr.withColumn("chunk", chunk).select(*keys, F.explode(F.arrays_zip("ws", "chunk")).alias("z")).select(*keys, F.col("z.ws.o").alias(order), F.col("z.chunk").alias("chunk"))
