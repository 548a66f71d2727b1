"""Joins of boxes on one page that stay quick on crowded pages.

A page's boxes meet as a hash or merge join on (document, page) with the geometry as residual condition, which compares all of
them. Where a page has so many that their product passes a limit, its boxes are dealt into tiles as large as its outer boxes
are on average, each box to every tile it reaches into, and only boxes in one tile meet. A pair that shares several tiles is
judged in the one that holds the lower left corner of the boxes' intersection, so it is found once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_number"]
#: Pairs of a page up to which they are compared plainly; tiles of a page in one direction at most.
PAIRS, TILES = 1 << 20, 256
#: Crowded pages that the driver holds and broadcasts; more stay a table.
FEW = 10_000


def crowded_pages(inner: DataFrame, outer: DataFrame, limit: int = PAIRS, points: bool = False) -> DataFrame:
    """(doc_id, page_number, __left, __bottom, __wide, __high): pages whose boxes times outer boxes pass ``limit``, with the corner
    and size of their tiles. A page's rows are counted map-side."""
    x, y = ("x", "y") if points else ("x0", "y0")
    one = inner.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("ax"), F.min(y).alias("ay"))
    span = lambda k: (F.max(f"{k}1") - F.min(f"{k}0")).alias(f"s{k}")
    two = outer.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("m"), F.min("x0").alias("bx"), F.min("y0").alias("by"), F.avg(F.expr("x1 - x0")).alias("wx"), F.avg(F.expr("y1 - y0")).alias("wy"), span("x"), span("y"))
    some = one.join(two, PAGE).where(F.col("n") * F.col("m") > limit)
    size = lambda k: F.greatest(F.col(f"w{k}"), F.col(f"s{k}") / TILES, F.lit(1e-9))
    corner = F.least("ax", "bx").alias("__left"), F.least("ay", "by").alias("__bottom")
    return some.select(*PAGE, *corner, size("x").alias("__wide"), size("y").alias("__high"))


def _tile(value: str, start: str, size: str) -> str:
    """SQL of the tile of a place. All beyond the last one are in it, so a box far off or of any size covers few."""
    return f"CAST(least(greatest(floor(({value} - {start}) / {size}), -1), {4 * TILES}) AS INT)"


def _tiled(rows: DataFrame, pages: DataFrame, slack: float, points: bool = False) -> DataFrame:
    """``rows`` of crowded pages, once for each tile (__tx, __ty) that they reach into."""
    for k, start, size in (("x", "__left", "__wide"), ("y", "__bottom", "__high")):
        low, high = (k, k) if points else (f"{k}0 - {slack}D", f"{k}1 + {slack}D")
        reach = f"sequence({_tile(low, start, size)}, greatest({_tile(low, start, size)}, {_tile(high, start, size)}))"
        rows = (rows.join(pages, PAGE) if k == "x" else rows).withColumn(f"__t{k}", F.explode(F.expr(reach)))
    return rows


def page_join(inner: DataFrame, outer: DataFrame, condition: str, how: str = "inner", slack: float = 0.0, limit: int = PAIRS, points: bool = False) -> DataFrame:
    """Structs ``p`` (of ``inner``) and ``b`` (of ``outer``) of one page for which ``condition`` on p and b holds; with ``how``
    left_anti the rows of ``inner`` that meet none. A count of the pages' boxes runs first and says which pages are crowded.

    The condition must imply that the boxes, ``outer`` widened by ``slack``, have a place in common (with ``points``, that
    the point x, y of ``inner`` lies in the widened box). Rows without coordinates meet none."""
    page = "p.doc_id = b.doc_id AND p.page_number = b.page_number"
    pair = [F.struct(*[F.col(f"{n}.`{c}`") for c in df.columns]).alias(n) for n, df in (("p", inner), ("b", outer))]
    pages = crowded_pages(inner, outer, limit, points)
    few = pages.limit(FEW + 1).collect()
    if not few:
        met = inner.alias("p").join(outer.alias("b"), F.expr(f"{page} AND {condition}"), how)
        return met if how == "left_anti" else met.select(*pair)
    if len(few) <= FEW:
        pages = inner.sparkSession.createDataFrame(few, pages.schema)
    names = pages.select(*PAGE)
    usual = inner.join(names, PAGE, "left_anti").alias("p").join(outer.join(names, PAGE, "left_anti").alias("b"), F.expr(f"{page} AND {condition}"), how)
    one, two = _tiled(inner, pages, 0.0, points).alias("p"), _tiled(outer, pages, slack).alias("b")
    tile = f"{page} AND p.__tx = b.__tx AND p.__ty = b.__ty AND {condition}"
    if how == "left_anti":  # a point lies in one tile, so a join by tile tells whether it meets any box
        return usual.select(*inner.columns).unionByName(one.join(two, F.expr(tile), "left_anti").select(*inner.columns))
    for k, start, size in (("x", "p.__left", "p.__wide"), ("y", "p.__bottom", "p.__high")):
        tile += f" AND p.__t{k} = {_tile(f'greatest(p.{k}' + ('' if points else '0') + f', b.{k}0 - {slack}D)', start, size)}"
    return usual.select(*pair).unionByName(one.join(two, F.expr(tile)).select(*pair))
