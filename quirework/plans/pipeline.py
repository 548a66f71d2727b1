"""From page records, or paragraphs and blocks, to translated Markdown, documents and draw plans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assets, categories, documents, drawing, extract, fit, geometry, markdown, match, merge, summary, translate, translation_cache
from ..sources import files
from .config import PipelineConfig
from .metrics import PipelineError, Stages

__all__ = ["PipelineConfig", "PipelineError", "Result", "run", "run_pages"]
Keep = Callable[[str, DataFrame], DataFrame]


@dataclass
class Result:
    paragraphs: DataFrame
    markdown: DataFrame
    base: DataFrame
    translations: DataFrame
    draw: DataFrame
    stats: DataFrame
    images: DataFrame | None = None
    tables: DataFrame | None = None
    summaries: DataFrame | None = None
    translated_summaries: DataFrame | None = None
    side_by_side: DataFrame | None = None
    thumbnails: DataFrame | None = None
    subsets: DataFrame | None = None
    stages: Stages | None = None
    written: tuple[str, ...] = field(default=("markdown", "base", "translations", "draw", "stats", "images", "side_by_side", "thumbnails", "subsets"))

    def write(self, keep: Keep) -> None:
        """Writes what is still to be made; an error of these actions names its table as its stage."""
        for name in self.written:
            if (made := getattr(self, name)) is not None:
                with self.stages.stage(name):
                    keep(name, made)

    @property
    def counts(self) -> dict[str, int]:
        """Totals of the run, observed as its tables were written: equal to the sums of ``stats``."""
        found = self.stages.counts
        before, after = found["categorize"]["rows"], found["merge"]["rows"]
        return {"original": before, "final": after, "merged": before - after, "translated": found["merge"]["translatable"], "skipped": after - found["merge"]["translatable"], "failed": found.get("translate", {}).get("failed", 0)}


def run(paragraphs: DataFrame, blocks: DataFrame | None, backend: translate.Backend, config: PipelineConfig, keep: Keep, progress: Callable[[str, int, int], None] | None = None, objects: DataFrame | None = None, ask: Callable[[str], str] | None = None, pages: DataFrame | None = None, cache: translation_cache.TranslationCache | None = None, run_name: str = "1", tasks: Callable[[str, int, int], None] | None = None) -> Result:
    """``keep`` writes a table and reads it again: the backend is called once, whatever is made of its answers. With
    ``blocks`` and ``objects`` (the pages' text objects), Markdown has the tables and images of the blocks. ``progress``
    hears of a stage when it is done, ``tasks`` of the tasks of a stage while it runs.

    ``ask`` puts a prompt to a language model (see config.model). ``pages`` (doc_id, page_number, w, h) gives thumbnails and
    pages side by side. With ``cache``, answers outlive the run and failed texts keep null. A column source_file of the
    paragraphs names files: base documents have it, translations the base document's name."""
    spark = paragraphs.sparkSession
    watched = Stages(spark, tasks)
    stages = ["categorize", "merge", "translate", *["tables"] * (blocks is not None and objects is not None), *["summary"] * config.summary, "assemble"]

    def at(name: str, f: Callable[[], DataFrame]) -> DataFrame:
        with watched.stage(name):
            out = f()
        if progress:
            progress(name, stages.index(name), len(stages))
        return out

    def translated() -> DataFrame:
        how = {"retries": config.max_retries, "delay": config.retry_delay, "limit": config.max_concurrent}
        if cache is not None:
            out = translation_cache.translate_cached(merged, backend, config.source_lang, config.target_lang, cache, run_name, config.batch_size, config.strict, config.translatable, **how)
            return keep("translated", watched.observe("translate", out, failed=F.count_if(F.col("error_class").isNotNull())))
        return keep("translated", translate.translate_paragraphs(merged, backend, config.source_lang, config.target_lang, config.batch_size, strict=config.strict, categories_=config.translatable, **how))

    given = watched.observe("categorize", paragraphs, rows=F.count(F.lit(1)))
    sorted_ = at("categorize", lambda: given if blocks is None else match.assign_categories(given, blocks, config.threshold))
    whole = at("merge", lambda: merge.merge_paragraphs(sorted_, config.merge) if config.merge_adjacent else merge.unmerged(sorted_))
    need = categories.translatable(F.col("category"), config.translatable)
    with watched.stage("merge"):
        merged = keep("merged", watched.observe("merge", whole, rows=F.count(F.lit(1)), translatable=F.count_if(need))).drop("input_pos")
    merged = merged.selectExpr("*", "CAST(page_number * 1000000L + out_pos AS BIGINT) AS input_pos")
    done = at("translate", translated)
    styled = done
    for name, default in (("rotation", F.lit(0.0)), ("alignment", F.lit("left"))):
        if name not in done.columns:  # paragraphs that came without styles are upright and left
            styled = styled.withColumn(name, default)
    meta = {"source_lang": config.source_lang, "target_lang": config.target_lang}
    look = markdown.MarkdownConfig(config.mode, meta, config.translated_at if config.metadata else None, config.page_breaks, config.heading_offset, skip=config.skip)
    tables_ = images = None
    if blocks is not None:
        tables_ = at("tables", lambda: keep("tables", assets.page_tables(blocks, objects, config.tables, config.table_mode))) if objects is not None and config.extract_tables else None
        images = assets.page_images(blocks, tables_, config.images.folder, config.images.naming == "page_index") if config.images.enabled else None
    shown = None if tables_ is None else tables_.where("markdown IS NOT NULL")
    base_summaries = translated_summaries = None
    if config.summary:

        def summed() -> DataFrame:
            text = markdown.documents(done, markdown.MarkdownConfig("original", page_breaks=config.page_breaks), images, shown) if config.model.use_summary and ask else None
            made = summary.base_summaries(done, text, ask, config.source_lang, config.model.use_fallback, config.model.use_summary)
            if thumbnails is not None:
                stem = F.regexp_replace(F.coalesce("source_file", F.col("doc_id").cast("string")) if named else F.col("doc_id").cast("string"), r"\.[^.]*$", "")
                names = (done.select("doc_id", "source_file").distinct() if named else done.select("doc_id").distinct()).select("doc_id", F.concat(stem, F.lit("_thumbnail.png")).alias("thumbnail_path"))
                made = made.join(names.join(thumbnails.select("doc_id", F.lit(config.thumbnail.width).alias("thumbnail_width"), F.col("height").alias("thumbnail_height")), "doc_id"), "doc_id", "left")
            return keep("summaries", made)

        def told() -> DataFrame:
            rows = base_summaries.select("doc_id", "title", "abstract")
            write = None
            if config.model.use_summary and ask:
                from ..operators import backends

                rows = rows.join(markdown.documents(done, markdown.MarkdownConfig("original", page_breaks=config.page_breaks), images, shown), "doc_id", "left")
                write = lambda text: ask(backends.summary_prompt(config.target_lang) + backends.summary_content(text))
            return keep("translated_summaries", summary.translated_summary(rows, backend, config.source_lang, config.target_lang, write))

    named = "source_file" in done.columns
    thumbnails = None
    if pages is not None and config.thumbnail is not None:
        counts = pages.groupBy("doc_id").agg((F.max("page_number") + 1).alias("page_count"))
        first = pages.withColumnsRenamed({"w": "page_width", "h": "page_height"})
        chosen = counts.withColumn("page_number", F.least(F.lit(config.thumbnail.page_number), F.col("page_count") - 1)).join(first, ["doc_id", "page_number"])
        thumbnails = geometry.thumbnails(chosen, config.thumbnail.page_number, config.thumbnail.width)
    if config.summary:
        base_summaries = at("summary", summed)
        with watched.stage("summary"):
            translated_summaries = told()
    beside = None if pages is None or config.side_by_side is None else geometry.side_by_side(pages, pages, config.side_by_side.gap).withColumn("order", F.lit(config.side_by_side.order))
    subsets = None
    if config.subset is not None:
        shown_text = done.withColumn("text", F.coalesce(F.nullif("translated_text", F.lit("")), F.lit("")))
        sets = summary.charsets(shown_text, summary.MARGIN if config.subset.margin else "")
        subsets = sets.join(summary.subset_keys(sets, config.subset.font, config.subset.number), ["doc_id", "is_bold", "is_italic"])
    made = at("assemble", lambda: markdown.documents(done, look, images, shown))
    base = documents.base_documents(done, config.source_lang, "source_file" if named else None, base_summaries)
    pointed = done.withColumn("base_file", files.base_name(F.col("source_file"))) if named else done
    translations = documents.translation_documents(pointed, config.target_lang, backend.name, config.translated_at or "", "base_file" if named else None, translated_summaries)
    draw = drawing.draw_plan(styled, config=fit.FitConfig(smallest=config.min_font_size))
    return Result(done, made, base, translations, draw, documents.run_stats(paragraphs, merged), images, tables_, base_summaries, translated_summaries, beside, thumbnails, subsets, watched)


def run_pages(docs: DataFrame, backend: translate.Backend, config: PipelineConfig, keep: Keep, detections: DataFrame | None = None, scale: float = 1.0, **how) -> Result:
    """:func:`run` from page records: ``docs`` (doc_id, pages as extract.PAGES, and source_file if there is one), with ``detections``
    (doc_id, page_number, boxes in pixels of ``scale`` a point) of a layout model, such as detect.analyse gives."""
    found = extract.paragraphs(docs, list(config.page_range) if config.page_range else None)
    found = found.withColumn("input_pos", F.expr("CAST(page_number * 1000000L + block AS BIGINT)")).drop("block")
    found = found.withColumns({"category": F.lit(None).cast("string"), "category_confidence": F.lit(None).cast("double"), "layout_block_id": F.lit(None).cast("string")})
    if "source_file" in docs.columns:
        found = found.join(docs.select("doc_id", "source_file"), "doc_id")
    sized = extract.select_pages(docs, list(config.page_range) if config.page_range else None)
    sized = sized.select("doc_id", "page_number", F.coalesce(F.get("page.bbox", F.lit(2)) - F.get("page.bbox", F.lit(0)), F.lit(0.0)).alias("w"), F.coalesce(F.get("page.bbox", F.lit(3)), "page.height").alias("h"))
    blocks = None
    if detections is not None:
        blocks = extract.page_detections(detections, [c for c, *_ in categories.CATEGORIES], scale, sized)
    return run(keep("paragraphs", found), blocks, backend, config, keep, pages=sized, **how)
