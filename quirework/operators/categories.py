"""Layout categories and their rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Category, priority, Markdown element, translatable, skipped in Markdown.
CATEGORIES = (
    ("text", 6, "p", True, False), ("vertical_text", 6, "p", True, False), ("paragraph_title", 6, "h2", False, False), ("doc_title", 6, "h1", False, False),
    ("abstract", 6, "p", True, False), ("aside_text", 6, "blockquote", True, True), ("inline_formula", 1, "code", False, False), ("display_formula", 1, "code_block", False, False),
    ("formula_number", 1, "p", False, True), ("algorithm", 2, "code_block", False, False), ("table", 3, "table", False, False), ("image", 4, "image", False, False),
    ("figure_title", 5, "caption", True, False), ("chart", 4, "image", False, False), ("header", 8, "p", False, True), ("header_image", 8, "image", False, True),
    ("footer", 8, "p", False, True), ("footer_image", 8, "image", False, True), ("number", 8, "p", False, True), ("reference", 9, "p", False, False),
    ("reference_content", 9, "p", False, False), ("footnote", 7, "p", False, True), ("vision_footnote", 7, "p", False, True), ("seal", 99, "p", False, True),
    ("content", 99, "p", False, False), ("unknown", 99, "p", False, False),
)
TRANSLATABLE = tuple(c for c, _, _, t, _ in CATEGORIES if t)
SKIPPED = (*(c for c, *_, s in CATEGORIES if s), "page_number")
NO_PRIORITY = 99


def dimension(spark: SparkSession) -> DataFrame:
    """26 rows whatever the data: always broadcast."""
    return F.broadcast(spark.createDataFrame(list(CATEGORIES), "category string, priority int, element string, translatable boolean, md_skip boolean"))


def _case(category: Column, at: int, default) -> Column:
    out = None
    for row in CATEGORIES:
        out = F.when(category == row[0], row[at]) if out is None else out.when(category == row[0], row[at])
    return out.otherwise(default)


def priority(category: Column) -> Column:
    return _case(category, 1, NO_PRIORITY)


def element(category: Column, overrides: dict[str, str] | None = None) -> Column:
    """Null and unlisted categories are paragraphs; overrides win."""
    out = _case(category, 2, "p")
    for k, v in (overrides or {}).items():
        out = F.when(category == k, v).otherwise(out)
    return F.when(category.isNull(), "p").otherwise(out)


def translatable(category: Column, chosen: tuple[str, ...] | None = None) -> Column:
    """A paragraph without category is translatable."""
    return category.isNull() | category.isin(*(TRANSLATABLE if chosen is None else chosen))


def skipped(category: Column, chosen: tuple[str, ...] | None = None) -> Column:
    """Null is never skipped; an empty choice skips nothing."""
    chosen = SKIPPED if chosen is None else chosen
    return F.coalesce(category.isin(*chosen), F.lit(False)) if chosen else F.lit(False)


def parse_filter(value: str | None) -> tuple[str, ...] | None:
    """``all``: every category; a list: its names, trimmed, empty ones dropped; nothing: the default."""
    if value is None:
        return TRANSLATABLE
    return tuple(c for c, *_ in CATEGORIES) if value == "all" else tuple(x for x in map(str.strip, value.split(",")) if x)


def image_block(category: Column) -> Column:
    """Blocks whose pixels are cut out: images and charts."""
    return F.coalesce(category.isin("image", "chart"), F.lit(False))


def table_block(category: Column) -> Column:
    return F.coalesce(category == "table", F.lit(False))


def listing(rows: DataFrame, category: str = "category") -> DataFrame:
    """(category, n), the most frequent first, then by name; null is a category of its own, last of equals."""
    return rows.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("category"))
