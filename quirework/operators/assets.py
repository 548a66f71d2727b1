"""Images and tables of pages, as the Markdown writer takes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import categories, documents, tables

BOX = ["x0", "y0", "x1", "y1"]


def page_tables(blocks: DataFrame, objects: DataFrame, config: tables.TableConfig = tables.TableConfig(), mode: str = "heuristic") -> DataFrame:
    """(doc_id, page_number, layout_block_id, box, input_pos, method, markdown) for each table block. markdown is null
    where the block has no objects or too small a grid: such a table is shown as an image."""
    some = blocks.where(categories.table_block(F.col("raw_category")))
    cells = tables.cells(tables.objects_in_tables(objects, some, config), config)
    made = tables.to_markdown(cells).join(tables.methods(cells, mode, config=config), "table_id")
    made = made.select("table_id", "method", F.when(F.col("method") == "heuristic", F.col("markdown")).alias("markdown"))
    named = some.withColumn("table_id", tables.table_id())
    return named.join(made, "table_id", "left").select("doc_id", "page_number", F.col("block_id").alias("layout_block_id"), *BOX, F.col("block_pos").alias("input_pos"), F.coalesce("method", F.lit("image")).alias("method"), "markdown")


def page_images(blocks: DataFrame, found: DataFrame | None = None, folder: str = "images", by_page: bool = False) -> DataFrame:
    """(doc_id, page_number, layout_block_id, box, input_pos, relative_path): files for image and chart blocks, and for
    the tables of ``found`` (as :func:`page_tables`) that have no Markdown. Files are numbered by document, or by page."""
    rows = blocks.where(categories.image_block(F.col("raw_category"))).withColumn("input_pos", F.col("block_pos"))
    parts = [documents.asset_manifest(rows, "image", folder, by_page)]
    if found is not None:
        rest = found.where("markdown IS NULL").withColumnRenamed("layout_block_id", "block_id")
        parts.append(documents.asset_manifest(rest, "table", folder, by_page))
    columns = ["doc_id", "page_number", "layout_block_id", *BOX, "input_pos", "relative_path"]
    out = parts[0].select(*columns)
    return out if len(parts) == 1 else out.unionByName(parts[1].select(*columns))
