"""What to remove from pages and what to draw on them, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from . import documents, fit, folds


def page_boxes(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, page_number, boxes) of the translated paragraphs: what is removed before drawing."""
    box = F.struct("x0", "y0", "x1", "y1")
    return paragraphs.where("translated_text <> ''").groupBy("doc_id", "page_number").agg(F.sort_array(F.collect_list(box)).alias("boxes"))


def draw_plan(paragraphs: DataFrame, font: fit.Font = fit.Font(), config: fit.FitConfig = fit.FitConfig()) -> DataFrame:
    """(doc_id, page_number, id, line_no, text, font_size, x, y): the fitted lines of each translated paragraph,
    by its rotation and alignment (nulls: upright, left)."""
    missing = {"rotation", "alignment"} - set(paragraphs.columns)
    if missing:
        raise ValueError(f"paragraphs need {sorted(missing)}")
    some = paragraphs.where("translated_text <> ''").withColumns({"rotation": F.coalesce("rotation", F.lit(0.0)), "alignment": F.coalesce("alignment", F.lit("left"))})
    rows = fit.fit(some.withColumn("text", F.col("translated_text")), font, config, ("doc_id", "page_number", "id", "x0", "y0", "x1", "y1", "rotation", "alignment"))
    lines = rows.select("*", F.posexplode("lines").alias("line_no", "l")).withColumn("width", F.col("l.width")).withColumn("y_position", F.col("l.y_position"))
    return fit.place_lines(lines).select("doc_id", "page_number", "id", "line_no", F.col("l.text").alias("text"), "font_size", "x", "y")


# Fonts that every reader has.
STANDARD_FONTS = ("Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique", "Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic", "Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique")


def template_plan(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, id, text, font_name, font_size, box, color, transform): what is drawn on a template whose own
    text has been removed. Objects of pages that the template hasn't got go; fonts that are not standard fall back to
    one that is, and texts to what such a font can show. ``pages``: doc_id, page_number of the template."""
    name, size = F.coalesce("font.name", F.lit("Times-Roman")), F.coalesce("font.size", F.lit(12.0))
    is_ = lambda c: F.coalesce(f"font.{c}", F.lit(False))
    font = F.when(name.isin(*STANDARD_FONTS), name).otherwise(documents.fallback_font(name, is_("is_bold"), is_("is_italic")))
    rows = objects.join(pages.select("doc_id", "page_number").distinct(), ["doc_id", "page_number"], "left_semi")
    text = t.ascii_fallback(t.normalise_controls(F.col("text")))
    return rows.select("doc_id", "page_number", "id", text.alias("text"), font.alias("font_name"), size.alias("font_size"), "x0", "y0", "x1", "y1", "color", "transform")


def remove_objects(objects: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Objects without those named in ``ids`` (doc_id, page_number, id); without ids, none is left."""
    return objects.limit(0) if ids is None else objects.join(ids, ["doc_id", "page_number", "id"], "left_anti")


def edit_stream(pages: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(doc_id, page_number, ops) of ``ops array<struct<op string, args array<double>>>`` and ``boxes``: text shown at a
    point in any box goes. The text position is the state of a fold over the page's operations; those that also move
    to the next line or set spacing keep that. Linear in a page's operations."""
    at = "(s.x BETWEEN b.x0 - {t} AND b.x1 + {t} AND {y} BETWEEN b.y0 - {t} AND b.y1 + {t})"
    here = f"exists(boxes, b -> {at.format(t=f'{tolerance}D', y='s.y')})"
    below = f"exists(boxes, b -> {at.format(t=f'{tolerance}D', y='(s.y - s.lead)')})"
    arg = lambda i: f"e.args[{i}]"
    op = lambda name, args="CAST(array() AS ARRAY<DOUBLE>)": f"named_struct('op', '{name}', 'args', {args})"
    moved = "e.op IN ('T*', '\\'', '\"')"
    x = f"CASE WHEN e.op = 'BT' THEN 0D WHEN NOT s.inside THEN s.x WHEN e.op = 'Tm' AND size(e.args) >= 6 THEN {arg(4)} WHEN e.op IN ('Td', 'TD') AND size(e.args) >= 2 THEN s.x + {arg(0)} ELSE s.x END"
    y = f"CASE WHEN e.op = 'BT' THEN 0D WHEN NOT s.inside THEN s.y WHEN e.op = 'Tm' AND size(e.args) >= 6 THEN {arg(5)} WHEN e.op IN ('Td', 'TD') AND size(e.args) >= 2 THEN s.y + {arg(1)} WHEN {moved} THEN s.y - s.lead ELSE s.y END"
    lead = f"CASE WHEN NOT s.inside THEN s.lead WHEN e.op = 'TD' AND size(e.args) >= 2 THEN -{arg(1)} WHEN e.op = 'TL' AND size(e.args) >= 1 THEN {arg(0)} ELSE s.lead END"
    kept = f"""CASE WHEN s.inside AND e.op IN ('Tj', 'TJ') AND {here} THEN slice(array(e), 1, 0)
      WHEN s.inside AND e.op = '\\'' AND {below} THEN array({op('T*')})
      WHEN s.inside AND e.op = '"' AND {below} THEN CASE WHEN size(e.args) >= 2 THEN array({op('Tw', f'array({arg(0)})')}, {op('Tc', f'array({arg(1)})')}, {op('T*')}) ELSE array({op('T*')}) END
      ELSE array(e) END"""
    start = "named_struct('inside', false, 'x', 0D, 'y', 0D, 'lead', 0D, 'out', slice(ops, 1, 0))"
    step = f"named_struct('inside', CASE WHEN e.op = 'BT' THEN true WHEN e.op = 'ET' THEN false ELSE s.inside END, 'x', {x}, 'y', {y}, 'lead', {lead}, 'out', concat(s.out, {kept}))"
    fold = F.expr(f"aggregate(ops, {start}, (s, e) -> {step}, s -> s.out)")
    # many operations: what becomes of each, then all at once
    code = "array_position(array({}), o.op)".format(", ".join("'" + n.replace("'", "\\'") + "'" for n in folds.OPS))
    six = f"array({', '.join(f'coalesce(get(o.args, {i}), 0D)' for i in range(6))})"
    sides = "flatten(transform(filter(boxes, b -> b IS NOT NULL), b -> array(b.x0, b.y0, b.x1, b.y1)))"
    given = [F.expr(f"transform(ops, o -> CAST({code} AS INT))"), F.expr("transform(ops, o -> coalesce(size(o.args), 0))"), F.expr(f"flatten(transform(ops, o -> {six}))"), F.expr(sides)]
    changed = f"""CASE a WHEN {folds.DROP} THEN slice(array(e), 1, 0) WHEN {folds.NEXT_LINE} THEN array({op('T*')})
      WHEN {folds.SPACED_NEXT_LINE} THEN array({op('Tw', f'array({arg(0)})')}, {op('Tc', f'array({arg(1)})')}, {op('T*')}) ELSE array(e) END"""
    actions = folds.routed(F.lit(None).cast("array<int>"), F.size("ops"), folds.stream(tolerance), *given)
    made = F.when(F.col("__actions").isNull(), fold).otherwise(F.expr(f"flatten(zip_with(ops, __actions, (e, a) -> {changed}))"))
    return pages.withColumn("__actions", actions).withColumn("ops", made).drop("__actions")
