"""Readers and writers of documents. PDF bytes come in as they are; decoding them is a codec's business."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import categories
from ..operators.documents import checked
from ..operators.extract import PAGES

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
FONT = "struct<name: string, size: double, is_bold: boolean, is_italic: boolean>"
OBJECT = f"struct<id: string, bbox: {BOX}, text: string, font: {FONT}, color: struct<r: int, g: int, b: int>, transform: struct<a: double, b: double, c: double, d: double, e: double, f: double>>"
BLOCK = f"struct<id: string, bbox: {BOX}, raw_category: string, type: string, confidence: double, page_num: int, text_object_ids: array<string>>"
PAGE = f"struct<page_number: int, width: double, height: double, rotation: int, text_objects: array<{OBJECT}>, layout_blocks: array<{BLOCK}>>"
CORE = f"struct<version: string, metadata: struct<source_file: string, created_at: string, page_count: int, pdf_version: string>, pages: array<{PAGE}>>"
CORE_VERSION = "1.0.0"


def read_binary(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, modificationTime, length, content: one row for each file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, json): whole files; the id is the file's name up to its last dot."""
    name = F.regexp_replace(F.element_at(F.split("_metadata.file_name", "/"), -1), r"\.[^.]*$", "")
    return spark.read.text(path, wholetext=True).select(name.alias("doc_id"), F.col("value").alias("json"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, pages) of JSON files of nested page, block, line and span records, as extract.paragraphs takes them."""
    return read_texts(spark, path).select("doc_id", F.from_json("json", PAGES).alias("pages"))


def parse_core(docs: DataFrame) -> DataFrame:
    """(doc_id, version, metadata, pages) of ``json``. A missing version counts as 1.0.0, another one raises."""
    d = docs.select("doc_id", F.from_json("json", CORE).alias("d"))
    return d.select("doc_id", checked(F.col("d"), "version", CORE_VERSION, CORE_VERSION).alias("version"), "d.metadata", "d.pages").where("version IS NOT NULL")


def text_objects(core: DataFrame) -> DataFrame:
    p = core.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.page_number", F.posexplode("p.text_objects").alias("pos", "o"))
    return p.select("doc_id", "page_number", "pos", "o.id", "o.text", "o.bbox.*", "o.font", "o.color", "o.transform")


def layout_blocks(core: DataFrame) -> DataFrame:
    """Blocks; an older key for the category is read too, and unlisted labels are ``unknown``."""
    p = core.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.page_number", F.posexplode("p.layout_blocks").alias("block_pos", "b"))
    label = F.coalesce("b.raw_category", "b.type")
    known = F.when(label.isin(*[c for c, *_ in categories.CATEGORIES]), label).otherwise("unknown")
    return p.select("doc_id", "page_number", "block_pos", F.col("b.id").alias("block_id"), known.alias("raw_category"), F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"), "b.bbox.*")


def attributes(objects: DataFrame) -> DataFrame:
    """Style from the font's name; the transform only where it is none of the identity (within 1e-6)."""
    low = F.lower(F.coalesce("font.name", F.lit("")))
    same = " AND ".join(f"abs(transform.{k} - {v}) < 1e-6" for k, v in zip("abcdef", (1, 0, 0, 1, 0, 0)))
    return objects.select(
        "doc_id", "page_number", "id", (low.contains("bold") | low.contains("medi")).alias("is_bold"), (low.contains("italic") | low.contains("oblique")).alias("is_italic"),
        F.when(~F.coalesce(F.expr(same), F.lit(True)), F.col("transform")).alias("transform"), "color",
    )


def core_documents(objects: DataFrame, pages: DataFrame, metadata: DataFrame) -> DataFrame:
    """(doc_id, json) from objects (as :func:`text_objects`), pages (doc_id, page_number, width, height, rotation) and
    metadata (doc_id, metadata). Null fields are left out; other alphabets are kept as they are."""
    item = F.struct("id", F.struct("x0", "y0", "x1", "y1").alias("bbox"), "text", "font", "color", "transform")
    own = objects.groupBy("doc_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", item.alias("o")))), lambda x: x["o"]).alias("text_objects"))
    empty = F.array().cast(own.schema["text_objects"].dataType)
    p = pages.join(own, ["doc_id", "page_number"], "left").withColumn("text_objects", F.coalesce("text_objects", empty))
    whole = p.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "width", "height", "rotation", "text_objects"))).alias("pages"))
    return whole.join(metadata, "doc_id").select("doc_id", F.to_json(F.struct(F.lit(CORE_VERSION).alias("version"), "metadata", "pages")).alias("json"))


def write_files(docs: DataFrame, content: str, path: str, files: int | None = None) -> None:
    """Texts as Parquet rows under ``path`` (doc_id, content); one row a document, as many files as tasks or ``files``."""
    out = docs.select("doc_id", F.col(content).alias("content"))
    (out.coalesce(files) if files else out).write.mode("overwrite").parquet(path)


def region_text(objects: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, page_number, region_id, text): objects whose centre lies in the region, in reading order."""
    inside = F.expr("o.doc_id = r.doc_id AND o.page_number = r.page_number AND (o.x0 + o.x1) / 2 BETWEEN r.x0 AND r.x1 AND (o.y0 + o.y1) / 2 BETWEEN r.y0 AND r.y1")
    rows = regions.alias("r").join(objects.alias("o"), inside)
    item = F.struct((-F.col("o.y1")).alias("k"), F.col("o.x0").alias("x"), F.col("o.pos").alias("pos"), F.col("o.text").alias("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), " ")
    return rows.groupBy("r.doc_id", "r.page_number", "r.region_id").agg(text.alias("text"))


def variant(fonts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(font, is_bold, file): the file of each wanted font in the asked weight, if there is one. ``fonts``: file."""
    weight = r"-(Thin|Light|DemiLight|Regular|Medium|Bold|Black)(?=\.[^.]*$)"
    name = F.when(F.col("font").rlike(weight), F.regexp_replace("font", weight, F.when(F.col("is_bold"), "-Bold").otherwise("-Regular")))
    return wanted.withColumn("__file", name).join(fonts.select("file"), F.col("__file") == F.col("file"), "left").drop("__file")


# What a plain face's name may end with, and endings of styled faces, the first found counts.
PLAIN_ENDINGS = ("-Regular", "-Text", "-Normal", "-Book", "Regular", "Text")
BOLD_ITALIC_ENDINGS = ("-BoldItalic", "-Bold Italic", "BoldItalic", "-SemiBoldItalic")
BOLD_ENDINGS = ("-Bold", "Bold", "-SemiBold", "-Medium")
ITALIC_ENDINGS = ("-Italic", "Italic", "-Oblique", "-TextItalic")


def style_variant(fonts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (font, is_bold, is_italic) with ``file``: the first styled face of the family that ``fonts`` (file)
    has, else the font itself. Null styles are plain; repeated rows are one."""
    endings = lambda names: F.array(*[F.lit(x) for x in names])
    bold, italic = F.coalesce("is_bold", F.lit(False)), F.coalesce("is_italic", F.lit(False))
    family, ending = F.regexp_replace("font", rf"(?:{'|'.join(PLAIN_ENDINGS)})?(?:\.[^.]*)?$", ""), F.regexp_extract("font", r"(\.[^.]*)?$", 1)
    styles = F.when(bold & italic, endings(BOLD_ITALIC_ENDINGS)).when(bold, endings(BOLD_ENDINGS)).when(italic, endings(ITALIC_ENDINGS))
    rows = wanted.select("font", "is_bold", "is_italic").distinct().withColumns({"family": family, "ending": ending})
    tried = rows.select("font", "is_bold", "is_italic", F.posexplode_outer(F.transform(styles, lambda x: F.concat("family", x, "ending"))).alias("at", "name"))
    found = tried.join(fonts.select(F.col("file").alias("name")).distinct().withColumn("is_there", F.lit(True)), "name", "left")
    first = F.min_by("name", F.when(F.col("is_there"), F.col("at")))
    return found.groupBy("font", "is_bold", "is_italic").agg(F.coalesce(F.when(F.bool_or("is_there"), first), "font").alias("file"))


def page_text(objects: DataFrame) -> DataFrame:
    """(doc_id, page_number, text): a page's objects in reading order."""
    item = F.struct((-F.col("y1")).alias("k"), F.col("x0").alias("x"), "pos", "text")
    return objects.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), " ").alias("text"))


def objects_by_id(objects: DataFrame, ids: DataFrame) -> DataFrame:
    """The objects that ``ids`` (doc_id, id) names."""
    return objects.join(ids.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_semi")


def empty_core(spark: SparkSession) -> DataFrame:
    """No documents, with the columns of :func:`parse_core`."""
    return spark.createDataFrame([], f"doc_id string, version string, metadata {CORE.split('metadata: ')[1].split(', pages')[0]}, pages array<{PAGE}>")


def ordered_pages(df: DataFrame) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number")))
