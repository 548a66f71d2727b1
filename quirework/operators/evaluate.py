"""Comparing versions of documents, and models' categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


BOX = ("x0", "y0", "x1", "y1")


def _matched(old: DataFrame, new: DataFrame) -> DataFrame:
    """Objects of both versions side by side; a version without font sizes has null ones."""
    cols = ("text", *BOX)

    def side(df: DataFrame, mark: str) -> DataFrame:
        size = F.col("original_font_size") if "original_font_size" in df.columns else F.lit(None)
        return df.select("doc_id", "id", *[F.col(c).alias(f"{mark}_{c}") for c in cols], size.cast("double").alias(f"{mark}_size"), F.lit(1).alias(mark))

    return side(old, "o").join(side(new, "n"), ["doc_id", "id"], "full")


def _shift() -> Column:
    """How far a box's edges have moved at most; null where one version has no box."""
    return F.greatest(*[F.abs(F.col(f"o_{c}") - F.col(f"n_{c}")) for c in BOX])


def _both() -> Column:
    return F.col("o").isNotNull() & F.col("n").isNotNull()


def _differs() -> Column:
    return F.coalesce(t.compare_key(F.col("o_text")), F.lit("")) != F.coalesce(t.compare_key(F.col("n_text")), F.lit(""))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """By document: ids only in one version, ids whose compared text differs, and the largest shift of a box's edge;
    where both versions have font sizes, also their largest difference."""
    out = [F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("o").isNull()).alias("extra"), F.count_if(_both() & _differs()).alias("text_mismatch"), F.max(_shift()).alias("position_error")]
    if all("original_font_size" in df.columns for df in (old, new)):
        out.append(F.max(F.abs(F.col("o_size") - F.col("n_size"))).alias("font_size_error"))
    return _matched(old, new).groupBy("doc_id").agg(*out)


def rates(old: DataFrame, new: DataFrame, tolerance: float) -> DataFrame:
    """Shares of a document's objects: found by id, with all edges within ``tolerance`` of their place, and different
    texts kept. Objects that agree in all are in ``agreement``."""
    m = old.select("doc_id", "id", *[F.col(c).alias(f"o_{c}") for c in BOX]).join(new.select("doc_id", "id", *[F.col(c).alias(f"n_{c}") for c in BOX]), ["doc_id", "id"], "left")
    found = m.groupBy("doc_id").agg((F.count("n_x0") / F.count(F.lit(1))).alias("match_rate"), (F.count_if(_shift() <= tolerance) / F.count(F.lit(1))).alias("position_rate"))
    texts = lambda df: df.select("doc_id", t.compare_key(F.col("text")).alias("text")).distinct()
    kept = texts(old).join(texts(new).withColumn("kept", F.lit(1)), ["doc_id", "text"], "left").groupBy("doc_id").agg((F.count("kept") / F.count(F.lit(1))).alias("preservation_rate"))
    return found.join(kept, "doc_id")


def agreement(old: DataFrame, new: DataFrame, position_tolerance: float = 50.0, font_size_tolerance: float = 0.5) -> DataFrame:
    """By document: its objects, ids only in one version, ids that differ in text, place or font size, the largest
    differences, and the share of objects that agree in all three within the tolerances (1 where there are none).
    Font sizes are compared where both versions have one."""
    size = F.abs(F.col("o_size") - F.col("n_size"))
    moved, resized = F.coalesce(_shift() > position_tolerance, F.lit(False)), F.coalesce(size > font_size_tolerance, F.lit(False))
    n = F.count("o")
    agreeing = F.count_if(_both() & ~_differs() & ~moved & ~resized)
    return _matched(old, new).groupBy("doc_id").agg(
        n.alias("objects"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("o").isNull()).alias("extra"),
        F.count_if(_both() & _differs()).alias("text_mismatch"), F.count_if(_both() & moved).alias("position_errors"), F.count_if(_both() & resized).alias("font_size_errors"),
        F.max(_shift()).alias("position_error"), F.max(size).alias("font_size_error"), F.when(n == 0, 1.0).otherwise(agreeing / n).alias("match_rate"),
    )


def category_counts(rows: DataFrame, models: list[str]) -> DataFrame:
    """Categories by model; one column each."""
    return rows.groupBy(F.coalesce("category", F.lit("none")).alias("category")).pivot("model", models).count().na.fill(0, models)


def category_sets(counts: DataFrame, a: str, b: str) -> DataFrame:
    """Which categories both models have, and which only one."""
    side = F.when((F.col(a) > 0) & (F.col(b) > 0), "common").when(F.col(a) > 0, f"only {a}").otherwise(f"only {b}")
    return counts.where((F.col(a) > 0) | (F.col(b) > 0)).select("category", side.alias("side"))
