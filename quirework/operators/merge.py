"""Columns of a page, and merging the paragraphs of a column: ordered folds over the rows of one (document, page)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import categories


@dataclass(frozen=True)
class MergeConfig:
    gap_tolerance: float = 0.5
    x_overlap_threshold: float = 0.7
    font_size_tolerance: float = 1.0
    width_tolerance: float = 0.95
    column_width_ratio: float = 0.5
    column_overlap: float = 0.5


FIELDS = ("id", "text", "x0", "y0", "x1", "y1", "line_count", "original_font_size", "category", "category_confidence", "is_bold", "is_italic", "input_pos")


def _extra(paragraphs: DataFrame) -> list[str]:
    """The columns that ride along: they are a paragraph's own, and a merged one has the first one's."""
    return [c for c in paragraphs.columns if c not in FIELDS and c not in ("doc_id", "page_number", "col", "seq", "out_pos", "extra")]


def detect_columns(paragraphs: DataFrame, config: MergeConfig = MergeConfig()) -> DataFrame:
    """Rows with ``col`` (from 0, left to right) and ``seq`` (order in the column before it is sorted).

    Paragraphs wider than half the page wait. The others, by their centres, join the last column if they overlap any of
    its members enough, else they open one. Then each wide one, in input order, goes to the column whose extent it
    overlaps most (the leftmost of equals, the first if none), and widens it."""
    extra = _extra(paragraphs)
    fields = [*FIELDS, *["extra"] * bool(extra)]
    some = paragraphs.withColumn("extra", F.struct(*[F.col(f"`{c}`") for c in extra])) if extra else paragraphs
    page = some.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("input_pos", *[f for f in fields if f != "input_pos"]))).alias("ps"))
    page = page.withColumn("limit", F.expr(f"array_max(transform(ps, p -> p.x1)) * {config.column_width_ratio}D"))
    page = page.withColumn("narrow", F.expr("array_sort(transform(filter(ps, p -> p.x1 - p.x0 <= limit), p -> named_struct('c', (p.x0 + p.x1) / 2, 'pos', p.input_pos, 'p', p)))"))
    page = page.withColumn("wide", F.expr("filter(ps, p -> p.x1 - p.x0 > limit)"))
    # last: members of the last column; cols: extents; out: (position, column)
    start = "named_struct('last', CAST(array() AS ARRAY<STRUCT<x0: DOUBLE, x1: DOUBLE>>), 'n', -1, 'out', CAST(array() AS ARRAY<STRUCT<pos: BIGINT, col: INT>>))"
    joins = f"exists(s.last, m -> {g.x_overlap('m', 'e.p')} >= {config.column_overlap}D)"
    step = f"""CASE WHEN {joins}
      THEN named_struct('last', concat(s.last, array(named_struct('x0', e.p.x0, 'x1', e.p.x1))), 'n', s.n, 'out', concat(s.out, array(named_struct('pos', CAST(e.pos AS BIGINT), 'col', s.n))))
      ELSE named_struct('last', array(named_struct('x0', e.p.x0, 'x1', e.p.x1)), 'n', s.n + 1, 'out', concat(s.out, array(named_struct('pos', CAST(e.pos AS BIGINT), 'col', s.n + 1)))) END"""
    page = page.withColumn("fold", F.expr(f"aggregate(narrow, {start}, (s, e) -> {step})"))
    page = page.withColumn("byp", F.expr("map_from_entries(transform(narrow, e -> struct(CAST(e.pos AS BIGINT), named_struct('x0', e.p.x0, 'x1', e.p.x1))))"))
    extents = """transform(sequence(0, fold.n), c -> named_struct(
        'x0', array_min(transform(filter(fold.out, o -> o.col = c), o -> byp[o.pos].x0)),
        'x1', array_max(transform(filter(fold.out, o -> o.col = c), o -> byp[o.pos].x1))))"""
    page = page.withColumn("extents", F.expr(f"CASE WHEN fold.n < 0 THEN CAST(array() AS ARRAY<STRUCT<x0: DOUBLE, x1: DOUBLE>>) ELSE {extents} END"))
    overlaps = "transform(s.ext, x -> greatest(least(x.x1, p.x1) - greatest(x.x0, p.x0), 0D))"
    pick = f"CASE WHEN array_max({overlaps}) > 0 THEN CAST(array_position({overlaps}, array_max({overlaps})) AS INT) - 1 ELSE 0 END"
    grow = f"transform(s.ext, (x, i) -> CASE WHEN i = {pick} THEN named_struct('x0', least(x.x0, p.x0), 'x1', greatest(x.x1, p.x1)) ELSE x END)"
    page = page.withColumn(
        "placed",
        F.expr(f"""CASE WHEN fold.n < 0 THEN transform(ps, p -> named_struct('pos', CAST(p.input_pos AS BIGINT), 'col', 0)) ELSE
        concat(fold.out, aggregate(wide, named_struct('ext', extents, 'out', CAST(array() AS ARRAY<STRUCT<pos: BIGINT, col: INT>>)),
          (s, p) -> named_struct('ext', {grow}, 'out', concat(s.out, array(named_struct('pos', CAST(p.input_pos AS BIGINT), 'col', {pick})))), s -> s.out)) END"""),
    )
    page = page.withColumn("all", F.expr("map_from_entries(transform(ps, p -> struct(CAST(p.input_pos AS BIGINT), p)))"))
    rows = page.select("doc_id", "page_number", "all", F.posexplode("placed").alias("seq", "o"))
    return rows.select("doc_id", "page_number", F.col("o.col").alias("col"), "seq", F.expr("all[o.pos]").alias("p")).select("doc_id", "page_number", "col", "seq", *[f"p.{f}" for f in FIELDS], *[F.col(f"p.extra.`{c}`") for c in extra])


def mergeable(last: str, cur: str, c: MergeConfig = MergeConfig()) -> str:
    """May ``cur``, the next one down, continue ``last``?"""
    names = ", ".join(f"'{x}'" for x in categories.TRANSLATABLE)
    gap, (wl, wc) = f"({last}.y0 - {cur}.y1)", (g.width(last), g.width(cur))
    return f"""coalesce({last}.category = {cur}.category AND {last}.category IN ({names}), false)
      AND {gap} >= 0 AND {gap} <= {last}.original_font_size * {c.gap_tolerance}D
      AND {g.x_overlap(last, cur)} >= {c.x_overlap_threshold}D
      AND abs({last}.original_font_size - {cur}.original_font_size) <= {c.font_size_tolerance}D
      AND NOT ({wl} > 0 AND {wc} > 0 AND least({wl}, {wc}) / greatest({wl}, {wc}) < {c.width_tolerance}D)"""


def merge_paragraphs(paragraphs: DataFrame, config: MergeConfig = MergeConfig()) -> DataFrame:
    """Paragraphs of each column, top down, merged into the one above where the rule allows; the rule is tested against
    what has been merged so far. Rows come with ``out_pos``, their order on the page. A merged paragraph has the first
    one's other columns (rotation, alignment, font, colour, block and whatever else there is)."""
    extra = _extra(paragraphs)
    fields = [*FIELDS, *["extra"] * bool(extra)]
    cols = detect_columns(paragraphs, config)
    if extra:
        cols = cols.withColumn("extra", F.struct(*[F.col(f"`{c}`") for c in extra]))
    item = F.struct((-F.col("y1")).alias("k"), "seq", *fields)
    arr = cols.groupBy("doc_id", "page_number", "col").agg(F.array_sort(F.collect_list(item)).alias("ps"))
    merged = {
        "text": "concat(l.text, '\\n', p.text)", "x0": "least(l.x0, p.x0)", "y0": "least(l.y0, p.y0)", "x1": "greatest(l.x1, p.x1)", "y1": "greatest(l.y1, p.y1)",
        "line_count": "l.line_count + p.line_count", "category_confidence": "least(l.category_confidence, p.category_confidence)",
    }
    both = ", ".join(f"'{f}', {merged.get(f, f'l.{f}')}" for f in ("k", "seq", *fields))
    step = f"transform(array(element_at(s, -1)), l -> CASE WHEN {mergeable('l', 'p', config)} THEN array(named_struct({both})) ELSE array(l, p) END)[0]"
    fold = f"aggregate(slice(ps, 2, size(ps)), slice(ps, 1, 1), (s, p) -> concat(slice(s, 1, size(s) - 1), {step}))"
    rows = arr.select("doc_id", "page_number", "col", F.posexplode(F.expr(fold)).alias("in_col", "p"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("p.y1")).alias("k"), "col", "in_col", F.col("p").alias("p"))))
    page = rows.groupBy("doc_id", "page_number").agg(order.alias("ps"))
    return page.select("doc_id", "page_number", F.posexplode("ps").alias("out_pos", "r")).select("doc_id", "page_number", "out_pos", F.col("r.col").alias("col"), *[f"r.p.{f}" for f in FIELDS], *[F.col(f"r.p.extra.`{c}`") for c in extra])


def unmerged(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs as :func:`merge_paragraphs` returns them, each by itself, in their own order."""
    at = F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("input_pos")) - 1
    return paragraphs.withColumn("out_pos", at).withColumn("col", F.lit(0))


def merge_growth(merged: DataFrame, original: DataFrame) -> DataFrame:
    """Merged paragraphs whose text grew by more than a tenth."""
    before = original.select("doc_id", "id", F.length("text").alias("before"))
    return merged.join(before, ["doc_id", "id"], "left").where("length(text) > coalesce(before, 0) * 1.1D")
