"""Paragraphs from nested page, block, line and span records (origin top left)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

SPAN = "struct<text: string, rotation: double, font: struct<size: double, weight: int, name: string, flags: int>>"
PAGES = f"array<struct<bbox: array<double>, height: double, blocks: array<struct<bbox: array<double>, lines: array<struct<bbox: array<double>, spans: array<{SPAN}>>>>>>>"


def select_pages(docs: DataFrame, page_range: list[int] | None) -> DataFrame:
    """(doc_id, page_number, page). If a document has as many pages as the range, the range renumbers them; else it
    picks pages by number."""
    rows = docs.select("doc_id", F.size("pages").alias("n"), F.posexplode("pages").alias("at", "page"))
    if page_range is None:
        return rows.select("doc_id", F.col("at").alias("page_number"), "page")
    numbers = F.array(*[F.lit(p) for p in page_range])
    renumbered = F.col("n") == len(page_range)
    rows = rows.where(renumbered | F.array_contains(numbers, F.col("at")))
    return rows.select("doc_id", F.when(renumbered, F.try_element_at(numbers, F.col("at") + 1)).otherwise(F.col("at")).alias("page_number"), "page")


BLOCK = ["doc_id", "page_number", "block"]


def _block_mode(spans: str, value: str, first_seen: bool, some: str = "true") -> str:
    """SQL of the weighted mode of ``value`` over an array of spans ``s`` (text, w, and n, the place): the one with most
    characters; of equals the first seen, or the smallest. Null where no span is in ``some``."""
    kept = f"filter({spans}, s -> {some})"
    seen = f"array_distinct(transform({kept}, s -> {value}))"
    weighed = f"transform({seen}, v -> named_struct('w', -aggregate(filter({kept}, s -> {value} = v), 0L, (a, s) -> a + s.w), 'v', v))"
    placed = f"transform({seen}, (v, i) -> named_struct('w', -aggregate(filter({kept}, s -> {value} = v), 0L, (a, s) -> a + s.w), 'i', i, 'v', v))"
    return f"array_min({placed if first_seen else weighed}).v"


def paragraphs(docs: DataFrame, page_range: list[int] | None = None) -> DataFrame:
    """(doc_id, page_number, id, text, box, line_count, style) from column ``pages`` (:data:`PAGES`). All that a
    paragraph needs lies in its block, so blocks are exploded and nothing is shuffled."""
    pages = select_pages(docs, page_range)
    h = F.coalesce(F.get("page.bbox", F.lit(3)), "page.height")
    rows = pages.select("doc_id", "page_number", h.alias("h"), F.posexplode("page.blocks").alias("block", "b")).where(F.size("b.bbox") == 4)
    # a line's spans as plain fields; blocks without spans or text go
    span = "named_struct('text', coalesce(s.text, ''), 'w', CAST(length(coalesce(s.text, '')) AS BIGINT), 'size', round(s.font.size, 1), 'weight', coalesce(s.font.weight, 400), 'flags', coalesce(s.font.flags, 0), 'name', coalesce(s.font.name, ''), 'rotation', degrees(coalesce(s.rotation, 0D)))"
    rows = rows.withColumn("ls", F.expr(f"transform(coalesce(b.lines, array()), l -> transform(coalesce(l.spans, array()), s -> {span}))"))
    texts = F.filter(F.transform("ls", lambda x: t.strip(F.array_join(F.transform(x, lambda s: s["text"]), ""))), lambda x: x != "")
    rows = rows.withColumn("ss", F.flatten("ls")).withColumn("texts", texts).where(F.size("texts") > 0)
    weight = "aggregate(ss, 0L, (a, s) -> a + s.w)"
    share = lambda c: F.expr(f"aggregate(filter(ss, s -> {c}), 0L, (a, s) -> a + s.w) * 2 > {weight}")
    name = "lower(s.name)"
    rows = rows.select(
        *BLOCK, "h", "b", t.collapse(F.array_join("texts", " ")).alias("text"), F.size("texts").cast("int").alias("line_count"),
        F.coalesce(F.expr(_block_mode("ss", "s.size", False, "s.size IS NOT NULL")), F.lit(12.0)).alias("original_font_size"),
        share(f"s.weight >= 700 OR contains({name}, 'bold') OR contains({name}, 'medi')").alias("is_bold"), share(f"s.flags & 64 <> 0 OR contains({name}, 'italic') OR contains({name}, 'oblique')").alias("is_italic"),
        F.expr(_block_mode("ss", "s.name", True, "s.name <> ''")).alias("font_name"), F.expr(_block_mode("ss", "s.rotation", True)).alias("rotation"),
    )
    h = F.coalesce("h", F.raise_error(F.lit("page without height")).cast("double"))
    box = lambda i: F.get("b.bbox", F.lit(i))
    turn = F.pmod("rotation", F.lit(360.0))
    upright = ~(turn.between(85, 95) | turn.between(265, 275))
    return rows.select(
        *BLOCK, F.format_string("para_p%d_b%d", "page_number", "block").alias("id"), "text", box(0).alias("x0"), (h - box(3)).alias("y0"), box(2).alias("x1"), (h - box(1)).alias("y1"), "line_count",
        "original_font_size", "is_bold", "is_italic", "font_name", F.lit(None).cast("struct<r:int,g:int,b:int>").alias("text_color"), "rotation", F.when(upright, alignment(F.col("b"))).otherwise("left").alias("alignment"),
    )


def alignment(block: Column) -> Column:
    """left, center, right or justify, of an upright block, from the spread of its lines' edges."""
    lines = F.filter(block["lines"], lambda x: F.size(x["bbox"]) == 4)
    left, right = F.transform(lines, lambda x: F.get(x["bbox"], F.lit(0))), F.transform(lines, lambda x: F.get(x["bbox"], F.lit(2)))
    centre = F.transform(lines, lambda x: (F.get(x["bbox"], F.lit(0)) + F.get(x["bbox"], F.lit(2))) / 2)
    spread = lambda a: F.array_max(a) - F.array_min(a)
    n = F.size(lines)
    inner = F.when(n >= 4, spread(F.slice(left, F.lit(2), F.greatest(n - 2, F.lit(0)))))
    middle = (F.get(block["bbox"], F.lit(0)) + F.get(block["bbox"], F.lit(2))) / 2
    one = F.when(F.abs(F.get(centre, F.lit(0)) - middle) < 5, "center").otherwise("left")
    many = (
        F.when((spread(left) < 5) & (spread(right) < 5), "justify").when(spread(left) < 5, "left").when(inner < 5, "left")
        .when((spread(right) < 5) & (spread(left) > 20), "right").when(spread(centre) < 10, "center").otherwise("left")
    )
    return F.when((n == 0) | (F.size(block["bbox"]) != 4), "left").when(F.size(block["lines"]) == 1, one).otherwise(many)


def text_objects(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, id, text) of column ``texts``: stripped and normalised; ids count what is left."""
    rows = pages.select("doc_id", "page_number", F.posexplode("texts").alias("at", "raw"))
    rows = rows.withColumn("text", t.strip(t.normalise_controls(F.col("raw")))).where("text <> ''")
    n = F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("at")) - 1
    return rows.select("doc_id", "page_number", F.format_string("text_p%d_i%d", "page_number", n).alias("id"), "text")


def detections(found: DataFrame, known: list[str], scale: float, page_height_px: float) -> DataFrame:
    """(doc_id, page_number, block_id, raw_category, confidence, box in points) from column ``boxes`` in pixels. Boxes
    without four coordinates go, unlisted labels are ``unknown``, and ids are digests of the content."""
    b = found.select("doc_id", "page_number", F.explode("boxes").alias("b")).where(F.size("b.coordinate") == 4)
    c = lambda i: F.get("b.coordinate", F.lit(i)) / scale
    y = lambda i: (F.lit(page_height_px) - F.get("b.coordinate", F.lit(i))) / scale
    return _blocks(b, known, c, y)


def page_detections(found: DataFrame, known: list[str], scale: float, pages: DataFrame) -> DataFrame:
    """:func:`detections` of pages of different heights (``pages``: doc_id, page_number, h in points), with ``block_pos``, the place of a box among
    its page's."""
    b = found.select("doc_id", "page_number", F.posexplode("boxes").alias("block_pos", "b")).where(F.size("b.coordinate") == 4)
    b = b.join(pages.select("doc_id", "page_number", "h"), ["doc_id", "page_number"])
    c = lambda i: F.get("b.coordinate", F.lit(i)) / scale
    return _blocks(b, known, c, lambda i: F.col("h") - c(i), F.col("block_pos").cast("long").alias("block_pos"))


def _blocks(b: DataFrame, known: list[str], c: Callable[[int], Column], y: Callable[[int], Column], *more: Column) -> DataFrame:
    label = F.when(F.col("b.label").isin(*known), F.col("b.label")).otherwise("unknown")
    name = F.sha2(F.to_json(F.struct("doc_id", "page_number", "b")), 256)
    return b.select("doc_id", "page_number", name.alias("block_id"), label.alias("raw_category"), F.col("b.score").alias("confidence"), c(0).alias("x0"), y(3).alias("y0"), c(2).alias("x1"), y(1).alias("y1"), *more)
