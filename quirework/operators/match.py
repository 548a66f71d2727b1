"""Matching boxes to layout blocks: joins on document and page with a containment predicate, best block first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import categories, spatial

THRESHOLD = 0.5


def containment_pairs(inner: DataFrame, outer: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Structs p and b: pairs on one page whose containment reaches the threshold. The join is a hash or merge join on
    (document, page), so a page's boxes meet each other only, and those of a crowded page by tiles."""
    pairs = spatial.page_join(inner, outer, f"{g.containment('p', 'b')} >= {threshold}D AND {g.intersection_area('p', 'b')} > 0")
    return pairs.withColumn("containment", F.expr(g.containment("p", "b")))


def assign_categories(paragraphs: DataFrame, blocks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The category, confidence and id of each paragraph's best block: least priority, then most containment, then
    block order; null where none fits."""
    best = containment_pairs(paragraphs.select("doc_id", "page_number", "id", "x0", "y0", "x1", "y1"), blocks, threshold)
    rank = F.struct(categories.priority(F.col("b.raw_category")), -F.col("containment"), F.col("b.block_pos"))
    found = best.groupBy(F.col("p.doc_id").alias("doc_id"), F.col("p.id").alias("id")).agg(F.min_by(F.struct("b.raw_category", "b.confidence", "b.block_id"), rank).alias("best"))
    rest = paragraphs.drop("category", "category_confidence", "layout_block_id")
    out = rest.join(found, ["doc_id", "id"], "left")
    return out.select(*rest.columns, F.col("best.raw_category").alias("category"), F.col("best.confidence").alias("category_confidence"), F.col("best.block_id").alias("layout_block_id"))


def match_text_objects(objects: DataFrame, blocks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, id, category): as above, but smaller blocks win ties before order, and what fits none is ``unknown``."""
    best = containment_pairs(objects, blocks, threshold)
    rank = F.struct(categories.priority(F.col("b.raw_category")), -F.col("containment"), F.expr(g.area("b")), F.col("b.block_pos"))
    found = best.groupBy(F.col("p.doc_id").alias("doc_id"), F.col("p.id").alias("id")).agg(F.min_by("b.raw_category", rank).alias("category"))
    return objects.select("doc_id", "id").join(found, ["doc_id", "id"], "left").withColumn("category", F.coalesce("category", F.lit("unknown")))


def translatable_objects(matched: DataFrame) -> DataFrame:
    return matched.where(F.col("category").isin(*categories.TRANSLATABLE))


def uncovered(points: DataFrame, boxes: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Points (doc_id, page_number, x, y) that lie in no box of their page."""
    inside = f"p.x BETWEEN b.x0 - {tolerance}D AND b.x1 + {tolerance}D AND p.y BETWEEN b.y0 - {tolerance}D AND b.y1 + {tolerance}D"
    return spatial.page_join(points, boxes, inside, "left_anti", tolerance, points=True)


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """Top row by key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
