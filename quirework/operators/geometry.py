"""Geometry over tables of boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g


def page_extents(boxes: DataFrame) -> DataFrame:
    """The union box of each page, its boxes and their area."""
    area = F.sum(F.expr("(x1 - x0) * (y1 - y0)")).alias("area")
    return boxes.groupBy("doc_id", "page_number").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("boxes"), area)


def neighbour_overlap(paragraphs: DataFrame) -> DataFrame:
    """Horizontal overlap of each paragraph with the next one of its page, by the smaller width."""
    p, b = paragraphs.alias("p"), paragraphs.alias("b")
    pairs = p.join(b, F.expr("p.doc_id = b.doc_id AND p.page_number = b.page_number AND b.input_pos = p.input_pos + 1"))
    return pairs.select("p.doc_id", "p.id", F.col("b.id").alias("other"), F.expr(g.x_overlap("p", "b")).alias("overlap"))


def side_by_side(left: DataFrame, right: DataFrame, gap: float) -> DataFrame:
    """Pages (doc_id, page_number, w, h) beside their counterparts, the lower one centred; different page counts raise."""
    both = left.withColumnsRenamed({"w": "lw", "h": "lh"}).join(right.withColumnsRenamed({"w": "rw", "h": "rh"}), ["doc_id", "page_number"], "full")
    wrong = F.raise_error(F.lit("documents have different page counts")).cast("double")
    lw, rw = F.coalesce("lw", wrong), F.coalesce("rw", wrong)
    height = F.greatest("lh", "rh")
    return both.select("doc_id", "page_number", (lw + gap + rw).alias("width"), height.alias("height"), ((height - F.col("lh")) / 2).alias("left_y"), ((height - F.col("rh")) / 2).alias("right_y"), (lw + gap).alias("right_x"))


def render_scale(dpi: Column) -> Column:
    return dpi / 72


def crops(blocks: DataFrame, dpi: float, margin: float, min_width: float, min_height: float) -> DataFrame:
    """Pixel crops of blocks (with page_width, page_height), grown by a margin, within the page, y down; small ones go."""
    s = dpi / 72
    out = blocks.where((F.col("x1") - F.col("x0") >= min_width) & (F.col("y1") - F.col("y0") >= min_height))
    clip = lambda x, most: F.greatest(F.lit(0.0), F.least(x, most))
    w, h = F.col("page_width"), F.col("page_height")
    return out.select(
        "*",
        (clip(F.col("x0") - margin, w) * s).cast("int").alias("left"), (clip(h - F.col("y1") - margin, h) * s).cast("int").alias("top"),
        (clip(F.col("x1") + margin, w) * s).cast("int").alias("right"), (clip(h - F.col("y0") + margin, h) * s).cast("int").alias("bottom"),
    )


def thumbnails(docs: DataFrame, page: int, width: int) -> DataFrame:
    """(doc_id, page, scale, height) of documents (doc_id, page_count, page_width, page_height); the last page if there
    are fewer."""
    scale = F.lit(width) / F.col("page_width")
    return docs.select("doc_id", F.least(F.lit(page), F.col("page_count") - 1).alias("page"), scale.alias("scale"), (F.col("page_height") * scale).cast("int").alias("height"))
