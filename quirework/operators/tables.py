"""Table grids from text objects (table_id, pos, text, x0, y0, x1, y1)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from . import folds, spatial


@dataclass(frozen=True)
class TableConfig:
    y_tolerance: float = 5.0
    column_gap: float = 20.0
    slack: float = 5.0
    min_rows: int = 2
    min_cols: int = 2


def table_id(prefix: str = "") -> Column:
    """A block's table, by document, page and block: a block's id may be found on several pages."""
    return F.concat_ws("/", F.col(f"{prefix}doc_id").cast("string"), F.col(f"{prefix}page_number").cast("string"), f"{prefix}block_id")


def objects_in_tables(objects: DataFrame, blocks: DataFrame, config: TableConfig = TableConfig()) -> DataFrame:
    """(table_id, pos, text, x0, y0, x1, y1) for each object whose whole box lies in a block's, give or take ``slack``.
    ``objects`` (pos, text, box) and ``blocks`` (block_id, box) join on document and page; the boxes are the residual
    condition, and those of a crowded page meet by tiles. table_id names document, page and block, so the table operators run on the result as it is."""
    inside = " AND ".join([f"p.{k}0 >= b.{k}0 - {config.slack}D AND p.{k}1 <= b.{k}1 + {config.slack}D" for k in "xy"])
    rows = spatial.page_join(objects, blocks, inside, slack=config.slack)
    return rows.select(table_id("b.").alias("table_id"), *[f"p.{c}" for c in ("pos", "text", "x0", "y0", "x1", "y1")])


def complex_merges(found: DataFrame) -> DataFrame:
    """(table_id, is_complex): has any cell that spans rows or columns?"""
    spans = F.greatest(F.coalesce("rowspan", F.lit(1)), F.coalesce("colspan", F.lit(1))) > 1
    return found.groupBy("table_id").agg(F.bool_or(spans).alias("is_complex"))


def _or(found: DataFrame, name: str, default) -> Column:
    """A cell's column, or its default where it is null or ``found`` hasn't got it."""
    return F.coalesce(name, F.lit(default)) if name in found.columns else F.lit(default)


def cluster_rows(objects: DataFrame, config: TableConfig = TableConfig()) -> DataFrame:
    """Objects with ``row`` (0 at the top) and ``in_row`` (left to right). A row takes what lies within the tolerance
    of its first object, so this is a fold; linear in a table's objects."""
    arr = objects.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("y0")).alias("k"), "pos", "text", "x0", "y0", "x1", "y1"))).alias("ts"))
    new = f"s.n < 0 OR abs(e.y0 - s.y) > {config.y_tolerance}D"
    fold = f"""aggregate(ts, named_struct('n', -1, 'y', 0D, 'out', CAST(array() AS ARRAY<INT>)), (s, e) -> named_struct('n', CASE WHEN {new} THEN s.n + 1 ELSE s.n END,
      'y', CASE WHEN {new} THEN e.y0 ELSE s.y END, 'out', concat(s.out, array(CASE WHEN {new} THEN s.n + 1 ELSE s.n END))), s -> s.out)"""
    row = folds.routed(F.expr(fold), F.size("ts"), folds.rows(config.y_tolerance), F.transform("ts", lambda x: x["y0"]))
    z = arr.withColumn("row", row).select("table_id", F.posexplode(F.arrays_zip("ts", "row")).alias("seq", "z"))
    rows = z.select("table_id", F.col("z.row").alias("row"), "seq", "z.ts.pos", "z.ts.text", "z.ts.x0", "z.ts.y0", "z.ts.x1", "z.ts.y1")
    return rows.withColumn("in_row", F.row_number().over(Window.partitionBy("table_id", "row").orderBy("x0", "seq")) - 1).drop("seq")


def column_bounds(objects: DataFrame, config: TableConfig = TableConfig()) -> DataFrame:
    """(table_id, col, left, right): cut in the middle of gaps between left edges."""
    w = Window.partitionBy("table_id").orderBy("x0")
    gaps = objects.select("table_id", "x0", F.lag("x0").over(w).alias("before"))
    cuts = F.array_sort(F.collect_list(F.when(F.col("x0") - F.col("before") > config.column_gap, (F.col("x0") + F.col("before")) / 2)))
    edges = gaps.groupBy("table_id").agg(F.concat(F.array(F.min("x0") - 5), cuts, F.array(F.max("x0") + 100)).alias("b"))
    return edges.select("table_id", "b", F.posexplode(F.slice("b", F.lit(1), F.size("b") - 1)).alias("col", "left")).select("table_id", "col", "left", F.element_at("b", F.col("col") + 2).alias("right"))


def cells(objects: DataFrame, config: TableConfig = TableConfig()) -> DataFrame:
    """(table_id, row, col, text, is_header): every row with every column, empty cells too."""
    rows, cols = cluster_rows(objects, config), column_bounds(objects, config)
    grid = rows.select("table_id", "row").distinct().join(cols, "table_id")
    inside = F.expr("g.table_id = r.table_id AND g.row = r.row AND (r.x0 + r.x1) / 2 >= g.left AND (r.x0 + r.x1) / 2 < g.right")
    found = grid.alias("g").join(rows.alias("r"), inside, "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r.text").isNotNull(), F.struct("r.in_row", "r.text")))), lambda x: x["text"]), " ")
    return found.groupBy("g.table_id", "g.row", "g.col").agg(text.alias("text")).withColumn("is_header", F.col("row") == 0)


def to_markdown(found: DataFrame) -> DataFrame:
    """(table_id, markdown). The first row is the header and gives the columns' ``alignment``, where there is one; short
    rows are padded."""
    rule = F.when(_or(found, "alignment", "left") == "center", ":---:").when(_or(found, "alignment", "left") == "right", "---:").otherwise("---")
    sorted_ = F.array_sort(F.collect_list(F.struct("col", t.escape_cell(F.col("text")).alias("text"), rule.alias("rule"))))
    rows = found.groupBy("table_id", "row").agg(F.transform(sorted_, lambda x: x["text"]).alias("cs"), F.transform(sorted_, lambda x: x["rule"]).alias("rs"))
    rows = rows.withColumn("n", F.max(F.size("cs")).over(Window.partitionBy("table_id")))
    line = lambda c, fill: F.concat(F.lit("| "), F.array_join(F.concat(c, F.array_repeat(F.lit(fill), F.col("n") - F.size(c))), " | "), F.lit(" |"))
    made = rows.withColumn("line", line("cs", "")).withColumn("rule", line("rs", "---"))
    both = F.array_sort(F.collect_list(F.struct("row", "line", "rule")))
    lines = F.flatten(F.transform(both, lambda x, i: F.when(i == 0, F.array(x["line"], x["rule"])).otherwise(F.array(x["line"]))))
    return made.groupBy("table_id").agg(F.array_join(lines, "\n").alias("markdown"))


def to_html(found: DataFrame, header_rows: int = 1) -> DataFrame:
    """(table_id, html); cells may have rowspan, colspan and alignment."""
    tag = F.when(F.col("is_header") | (F.col("row") < header_rows), "th").otherwise("td")
    span = lambda c: F.when(_or(found, c, 1) > 1, F.concat(F.lit(f' {c}="'), _or(found, c, 1).cast("string"), F.lit('"'))).otherwise("")
    style = F.when(_or(found, "alignment", "left") != "left", F.concat(F.lit(' style="text-align: '), _or(found, "alignment", "left"), F.lit('"'))).otherwise("")
    one = F.concat(F.lit("    <"), tag, span("rowspan"), span("colspan"), style, F.lit(">"), t.escape_html(F.col("text")), F.lit("</"), tag, F.lit(">"))
    cell = F.transform(F.array_sort(F.collect_list(F.struct("col", one.alias("one")))), lambda x: x["one"])
    rows = found.groupBy("table_id", "row").agg(F.concat(F.lit("  <tr>\n"), F.array_join(cell, "\n"), F.lit("\n  </tr>")).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"])
    return rows.groupBy("table_id").agg(F.concat(F.lit("<table>\n"), F.array_join(lines, "\n"), F.lit("\n</table>")).alias("html"))


def methods(found: DataFrame, mode: str = "heuristic", lined: bool = False, config: TableConfig = TableConfig()) -> DataFrame:
    """(table_id, method): heuristic where the grid is large enough; else the line-based reader where there is one
    (``lined``), else an image. Mode ``pdfplumber`` asks the line-based reader first, any other mode takes images."""
    size = found.groupBy("table_id").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    enough = (F.col("rows") >= config.min_rows) & (F.col("cols") >= config.min_cols)
    if mode == "heuristic":
        method = F.when(enough, "heuristic").otherwise("pdfplumber" if lined else "image")
    elif mode == "pdfplumber":
        method = F.lit("pdfplumber") if lined else F.when(enough, "heuristic").otherwise("image")
    else:
        method = F.lit("image")
    return size.select("table_id", method.alias("method"))
