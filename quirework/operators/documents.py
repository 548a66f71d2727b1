"""Documents as JSON, translations laid over them, and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import categories

VERSION = "2.0.0"
BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
# The fields of the format, in its order.
STYLE = {"rotation": "double", "alignment": "string", "layout_block_id": "string", "category": "string", "category_confidence": "double", "font_name": "string", "text_color": "struct<r: int, g: int, b: int>"}
PARAGRAPH = f"struct<id: string, page_number: int, text: string, block_bbox: {BOX}, line_count: int, original_font_size: double, is_bold: boolean, is_italic: boolean, {', '.join(f'{k}: {v}' for k, v in STYLE.items())}>"
SUMMARY = "struct<title: string, abstract: string, organization: string, summary: string, thumbnail_path: string, thumbnail_width: int, thumbnail_height: int, page_count: int, title_source: string, abstract_source: string>"
TRANSLATED_SUMMARY = "struct<title: string, abstract: string, organization: string, summary: string>"
BASE = f"struct<schema_version: string, metadata: struct<source_file: string, source_lang: string, page_count: int, paragraph_count: int>, summary: {SUMMARY}, paragraphs: array<{PARAGRAPH}>>"
TRANSLATION = f"struct<schema_version: string, target_lang: string, base_file: string, translated_at: string, translator_backend: string, translated_count: int, summary: {TRANSLATED_SUMMARY}, paragraphs: map<string, string>>"


def overlay(base: DataFrame, translations: DataFrame) -> DataFrame:
    """``base`` with translated_text; a missing translation is null."""
    return base.drop("translated_text").join(translations.select("doc_id", "id", "translated_text"), ["doc_id", "id"], "left")


def _with_summary(made: DataFrame, summaries: DataFrame | None, kind: str) -> DataFrame:
    """``made`` with the document's ``summary``, a struct of ``kind``, or null."""
    if summaries is None:
        return made.withColumn("summary", F.lit(None).cast(kind))
    fields = [f.split(":") for f in kind[7:-1].split(",")]
    own = F.struct(*[(F.col(n.strip()) if n.strip() in summaries.columns else F.lit(None)).cast(t.strip()).alias(n.strip()) for n, t in fields])
    return made.join(summaries.select("doc_id", own.alias("summary")), "doc_id", "left")


def base_documents(paragraphs: DataFrame, source_lang: str, source_file: str | None = None, summaries: DataFrame | None = None) -> DataFrame:
    """(doc_id, json): version 2.0.0, without translations; null fields are left out. Columns of :data:`STYLE` that
    ``paragraphs`` hasn't are null; ``source_file`` names a column; ``summaries`` has doc_id and fields of :data:`SUMMARY`."""
    style = [(F.col(k) if k in paragraphs.columns else F.lit(None)).cast(v).alias(k) for k, v in STYLE.items()]
    p = F.struct("id", "page_number", "text", F.struct("x0", "y0", "x1", "y1").alias("block_bbox"), "line_count", "original_font_size", "is_bold", "is_italic", *style)
    ps = F.transform(F.array_sort(F.collect_list(F.struct("input_pos", p.alias("p")))), lambda x: x["p"])
    name = F.first(source_file) if source_file else F.lit(None).cast("string")
    meta = F.struct(name.alias("source_file"), F.lit(source_lang).alias("source_lang"), (F.max("page_number") + 1).alias("page_count"), F.count(F.lit(1)).cast("int").alias("paragraph_count"))
    made = _with_summary(paragraphs.groupBy("doc_id").agg(meta.alias("metadata"), ps.alias("paragraphs")), summaries, SUMMARY)
    return made.select("doc_id", F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), "metadata", "summary", "paragraphs")).alias("json"))


def checked(parsed: Column, name: str = "schema_version", expected: str = VERSION, default: str | None = None) -> Column:
    """The version, or an error where it is another one."""
    version = F.coalesce(parsed[name], F.lit(default)) if default else parsed[name]
    return F.when(version.eqNullSafe(F.lit(expected)), version).otherwise(F.raise_error(F.concat(F.lit("unsupported version: "), F.coalesce(version, F.lit("none")))).cast("string"))


def _parsed(docs: DataFrame, kind: str) -> DataFrame:
    return docs.select("doc_id", F.from_json("json", kind).alias("d")).withColumn("version", checked(F.col("d"))).where("version IS NOT NULL")


def read_base(docs: DataFrame) -> DataFrame:
    """Paragraphs of ``json`` with their boxes and style, input_pos and the document's fields."""
    d = _parsed(docs, BASE)
    d = d.select("doc_id", F.col("version").alias("schema_version"), F.col("d.metadata.paragraph_count").cast("long").alias("paragraph_count"), F.col("d.metadata.page_count").alias("page_count"), F.col("d.metadata.source_file").alias("source_file"), F.col("d.metadata.source_lang").alias("source_lang"), F.posexplode("d.paragraphs").alias("input_pos", "p"))
    return d.select("doc_id", "schema_version", "paragraph_count", "page_count", "source_file", "source_lang", "input_pos", "p.id", "p.page_number", "p.text", "p.block_bbox.*", "p.line_count", "p.original_font_size", "p.is_bold", "p.is_italic", *[f"p.{k}" for k in STYLE])


def read_summaries(docs: DataFrame, translated: bool = False) -> DataFrame:
    """(doc_id, and the fields of the summary) of base or translation documents that have one."""
    d = _parsed(docs, TRANSLATION if translated else BASE)
    return d.where("d.summary IS NOT NULL").select("doc_id", "d.summary.*")


def translation_documents(paragraphs: DataFrame, target_lang: str, backend: str, translated_at: str, base_file: str | None = None, summaries: DataFrame | None = None) -> DataFrame:
    """(doc_id, json): the translations that are not empty, by paragraph id. ``base_file`` names a column; ``summaries``
    has doc_id and fields of :data:`TRANSLATED_SUMMARY`."""
    some = paragraphs.where("translated_text <> ''")
    ps = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("input_pos", "id", "translated_text"))), lambda x: F.struct(x["id"], x["translated_text"])))
    name = F.first(base_file) if base_file else F.lit(None).cast("string")
    made = _with_summary(some.groupBy("doc_id").agg(ps.alias("ps"), name.alias("base")), summaries, TRANSLATED_SUMMARY)
    fields = {"schema_version": F.lit(VERSION), "target_lang": F.lit(target_lang), "base_file": F.col("base"), "translated_at": F.lit(translated_at), "translator_backend": F.lit(backend), "translated_count": F.size("ps"), "summary": F.col("summary"), "paragraphs": F.col("ps")}
    return made.select("doc_id", F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("json"))


def read_translations(docs: DataFrame) -> DataFrame:
    """(doc_id, target_lang, base_file, translated_count, id, text)."""
    d = _parsed(docs, TRANSLATION)
    count = F.when(F.col("d.translated_count") == F.size("d.paragraphs"), F.col("d.translated_count")).otherwise(F.raise_error(F.lit("translated_count is not the number of translations")).cast("int"))
    return d.select("doc_id", "d.target_lang", "d.base_file", count.alias("translated_count"), F.explode("d.paragraphs").alias("id", "text"))


def run_stats(original: DataFrame, final: DataFrame) -> DataFrame:
    """Paragraphs before and after merging, and how many of these a translator gets."""
    a = original.groupBy("doc_id").agg(F.count(F.lit(1)).alias("original"))
    b = final.groupBy("doc_id").agg(F.count(F.lit(1)).alias("final"), F.count_if(categories.translatable(F.col("category"))).alias("translated"))
    return a.join(b, "doc_id").select("doc_id", "original", "final", (F.col("original") - F.col("final")).alias("merged"), "translated", (F.col("final") - F.col("translated")).alias("skipped"))


def numbered(rows: DataFrame, prefix: str, by_page: bool = False) -> DataFrame:
    """Rows with ``n`` and a name such as table_001, counted by document or page."""
    keys = ["doc_id", "page_number"] if by_page else ["doc_id"]
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("input_pos"))
    name = F.format_string(f"{prefix}_%03d", "n")
    return rows.withColumn("n", n).withColumn("name", F.concat(F.format_string("p%d_", F.col("page_number") + 1), name) if by_page else name)


# What in a name tells a family; monospaced families are looked for first.
MONO = ("courier", "mono", "consola", "inconsolata", "menlo", "source code", "fira code")
SERIF = ("times", "roman", "serif", "nimbus", "palatino", "georgia", "garamond", "cambria", "book")


def fallback_font(name: Column, bold: Column, italic: Column) -> Column:
    """One of twelve standard fonts."""
    low = F.lower(name)
    has = lambda words: low.rlike("|".join(words))
    style = lambda plain, slant: F.when(bold & italic, f"-Bold{slant}").when(bold, "-Bold").when(italic, f"-{slant}").otherwise(plain)
    return F.when(has(MONO), F.concat(F.lit("Courier"), style("", "Oblique"))).when(has(SERIF), F.concat(F.lit("Times"), style("-Roman", "Italic"))).otherwise(F.concat(F.lit("Helvetica"), style("", "Oblique")))


def markdown_name(stem: Column) -> Column:
    return F.concat(F.regexp_replace(stem, r"\.[^.]*$", ""), F.lit(".md"))


def side_by_side_name(stem: Column, extension: str = ".pdf") -> Column:
    return F.concat(F.regexp_replace(stem, r"\.[^.]*$", ""), F.lit(f"_side_by_side{extension}"))


def asset_manifest(blocks: DataFrame, prefix: str, folder: str, by_page: bool = False) -> DataFrame:
    """(doc_id, page_number, layout_block_id, box, input_pos, name, relative_path): files that images, tables or crops are written
    to, numbered by document or page. ``blocks``: block_id, box, input_pos."""
    rows = numbered(blocks, prefix, by_page)
    return rows.select("doc_id", "page_number", F.col("block_id").alias("layout_block_id"), "x0", "y0", "x1", "y1", "input_pos", "name", F.concat(F.lit(folder.rstrip("/") + "/"), "name", F.lit(".png")).alias("relative_path"))
