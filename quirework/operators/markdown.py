"""Markdown of documents from their paragraphs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import categories


@dataclass(frozen=True)
class MarkdownConfig:
    mode: str = "translated"  # translated, original or parallel
    metadata: dict[str, str] = field(default_factory=dict)  # title, source_lang, target_lang
    translated_at: str | None = None  # the clock is given; no front matter without it
    page_breaks: bool = True
    heading_offset: int = 0
    overrides: dict[str, str] | None = None
    skip: tuple[str, ...] | None = None


def _full(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def front_matter(config: MarkdownConfig) -> str | None:
    if config.translated_at is None:
        return None
    names = [f"{k}: {config.metadata[k]}" for k in ("title", "source_lang", "target_lang") if config.metadata.get(k)]
    return "\n".join(["---", *names, f"translated_at: {config.translated_at}", "---"]) + "\n"


def lookup_key(prefix: str = "") -> Column:
    c = lambda n: F.col(f"{prefix}{n}")
    place = F.concat(F.lit("p"), c("page_number").cast("string"), *[x for n in ("x0", "y0", "x1", "y1") for x in (F.lit("_"), F.format_string("%.1f", c(n)))])
    return F.coalesce(_full(c("layout_block_id")), place)


def styled(text: Column) -> Column:
    bold, italic = F.coalesce(F.col("is_bold"), F.lit(False)), F.coalesce(F.col("is_italic"), F.lit(False))
    mark = F.when(bold & italic, "***").when(bold, "**").when(italic, "*").otherwise("")
    return F.concat(mark, text, mark)


def formatted(kind: Column, text: Column, offset: int = 0, translation: bool = False) -> Column:
    """Ends with a line feed. A translation beside the original is not set as code."""
    quote = F.array_join(F.transform(F.split(text, "\n"), lambda line: F.concat(F.lit("> "), line)), "\n")
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.substring(kind, 2, 1).try_cast("int") + offset))
    out = F.when(kind.rlike("^h[1-6]$"), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).when(kind == "blockquote", quote).when(kind == "caption", F.concat(F.lit("*"), text, F.lit("*")))
    if not translation:
        out = out.when(kind == "code", F.concat(F.lit("`"), text, F.lit("`"))).when(kind == "code_block", F.concat(F.lit("```\n"), text, F.lit("\n```")))
    return F.concat(out.otherwise(text), F.lit("\n"))


def _latest(df: DataFrame, value: Column, name: str) -> DataFrame:
    """key -> value; of rows with one key the last counts."""
    return df.groupBy("doc_id", lookup_key().alias("key")).agg(F.max_by(value, "input_pos").alias(name))


def blocks(paragraphs: DataFrame, config: MarkdownConfig = MarkdownConfig(), images: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos, md): what each paragraph writes, page breaks included.

    Page breaks come from the sequence of all paragraphs, skipped ones too. An image or table is written by the first
    paragraph with its key that can; an image without file writes nothing, a table without content its text."""
    order = Window.partitionBy("doc_id").orderBy("input_pos")
    p = paragraphs.withColumn("__before", F.lag("page_number").over(order)).withColumn("__kind", categories.element(F.col("category"), config.overrides))
    translated = _full(F.col("translated_text")) if "translated_text" in paragraphs.columns else F.lit(None).cast("string")
    p = p.withColumn("__text", _full(F.coalesce(translated, F.col("text")) if config.mode == "translated" else F.col("text")))
    p = p.withColumn("__shown", ~categories.skipped(F.col("category"), config.skip) & F.col("__text").isNotNull())
    if "layout_block_id" not in p.columns:
        p = p.withColumn("layout_block_id", F.lit(None).cast("string"))
    p = p.withColumn("key", lookup_key())
    for df, value, name in ((images, F.col("relative_path"), "__image"), (tables, F.col("markdown"), "__table")):
        p = p.withColumn(name, F.lit(None).cast("string")) if df is None else p.join(_latest(df, value, name), ["doc_id", "key"], "left")
    asset = F.when(F.col("__kind") == "image", F.col("__image").isNotNull()).when(F.col("__kind") == "table", F.col("__table").isNotNull() | F.col("__image").isNotNull()).otherwise(False)
    p = p.withColumn("__asset", asset & F.col("__shown"))
    p = p.withColumn("__turn", F.sum(F.col("__asset").cast("int")).over(Window.partitionBy("doc_id", "key").orderBy("input_pos")))
    plain = formatted(F.col("__kind"), styled(F.col("__text")), config.heading_offset)
    if config.mode == "parallel":
        plain = F.when(translated.isNotNull(), F.concat(plain, formatted(F.col("__kind"), styled(translated), config.heading_offset, True))).otherwise(plain)
    picture = F.concat(F.lit("![Image]("), F.col("__image"), F.lit(")\n"))
    table = F.when(F.col("__table").isNotNull(), F.concat("__table", F.lit("\n"))).otherwise(F.concat(F.lit("![Table]("), F.col("__image"), F.lit(")\n")))
    seen = F.coalesce(F.col("__turn"), F.lit(0)) > F.col("__asset").cast("int")
    md = F.when(~F.col("__shown"), None).when(F.col("__kind") == "image", F.when(F.col("__asset") & ~seen, picture))
    md = md.when(F.col("__kind") == "table", F.when(seen | (F.col("__turn") > 1), None).when(F.col("__asset"), table).otherwise(F.concat("__text", F.lit("\n")))).otherwise(plain)
    p = p.withColumn("__md", md)
    mark = F.when(F.col("page_number") != F.col("__before"), F.concat(F.lit("\n---\n<!-- Page "), (F.col("page_number") + 1).cast("string"), F.lit(" -->\n"))) if config.page_breaks else F.lit(None).cast("string")
    return p.select("doc_id", F.col("input_pos").alias("pos"), F.concat_ws("\n", mark, "__md").alias("md"), (mark.isNotNull() | F.col("__md").isNotNull()).alias("some"))


def documents(paragraphs: DataFrame, config: MarkdownConfig = MarkdownConfig(), images: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    """(doc_id, markdown)."""
    rows = blocks(paragraphs, config, images, tables)
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("some"), F.struct("pos", "md")))), lambda x: x["md"])
    head = front_matter(config)
    return rows.groupBy("doc_id").agg(F.concat_ws("\n", *([F.lit(head)] if head else []), parts).alias("markdown"))
