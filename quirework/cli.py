"""python -m quirework.cli query NAME FOLDER [--out PATH]: runs a query of the catalog over a folder of tables.

python -m quirework.cli translate INPUT OUT [--pages] [--backend NAME] ...: runs the pipeline over a table of paragraphs (and
blocks), or over a folder of page records, and writes paragraphs, Markdown, documents, translations, summaries, draw plans
and statistics under OUT.
The first form also goes without the word query."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import categories, documents, merge
from .plans import config as config_


def run_query(spark: SparkSession, args: argparse.Namespace) -> None:
    from . import catalog, catalog_services  # noqa: F401

    rows = catalog.QUERIES[args.query](spark, args.folder)
    rows.write.mode("overwrite").parquet(args.out) if args.out else rows.show(truncate=80)


def config_of(args: argparse.Namespace) -> config_.PipelineConfig:
    """The run's settings from the command line."""
    names = None if not args.translate_categories else categories.parse_filter(args.translate_categories)
    skip = () if args.markdown_include_all else categories.parse_filter(args.markdown_skip) if args.markdown_skip else None
    return config_.PipelineConfig(
        source_lang=args.source, target_lang=args.target, strict=args.strict, page_breaks=not args.no_page_breaks, metadata=not args.no_metadata, translated_at=args.translated_at,
        mode=config_.MODES[args.markdown_mode], heading_offset=args.heading_offset, skip=skip, translatable=categories.parse_filter("all") if args.translate_all else names,
        page_range=tuple(int(x) for x in args.page_range.split(",")) if args.page_range else None, threshold=args.threshold, batch_size=args.batch_size, max_concurrent=args.max_concurrent,
        merge_adjacent=not args.no_merge, merge=merge.MergeConfig(gap_tolerance=args.merge_gap, x_overlap_threshold=args.merge_overlap, font_size_tolerance=args.merge_font_size, width_tolerance=args.merge_width),
        extract_tables=not args.no_extract_tables, table_mode=args.table_mode, images=config_.ImageConfig(enabled=not args.no_extract_images, format=args.image_format, quality=args.image_quality, dpi=args.image_dpi),
        side_by_side=config_.SideBySideConfig(args.side_by_side, args.side_by_side_gap) if args.side_by_side else None, thumbnail=config_.ThumbnailConfig(args.thumbnail_width) if args.thumbnail else None,
        model=config_.ModelConfig(args.llm_provider, args.llm_model, args.llm_summary, args.llm_fallback), subset=config_.SubsetConfig() if args.subsets else None,
    )


def run_pipeline(spark: SparkSession, args: argparse.Namespace) -> None:
    from .operators import backends, translation_cache
    from .plans import pipeline
    from .sources import documents as sources
    from .sources import files

    def keep(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{args.out}/{name}")
        return spark.read.parquet(f"{args.out}/{name}")

    settings = config_of(args)
    used = backends.backend(args.backend, os.environ.get(args.key_variable, ""), args.model, args.api_url)
    ask = None
    if settings.model.use_summary or settings.model.use_fallback:
        if not args.llm_url:
            raise SystemExit("summaries of a model need --llm-url")
        ask = backends.ChatBackend(args.llm_url, os.environ.get(args.llm_key_variable, ""), settings.model.effective_model).ask
    how = {"ask": ask, "cache": translation_cache.TranslationCache(spark, args.cache) if args.cache else None, "run_name": args.run_name}
    how["tasks"] = (lambda stage, done, of: print(f"{stage}: {done} of {of} tasks", file=sys.stderr)) if args.verbose else None
    if args.pages:
        docs = sources.read_pages(spark, args.input).withColumn("source_file", F.concat("doc_id", F.lit(".pdf")))
        found = spark.read.parquet(args.detections) if args.detections else None
        out = pipeline.run_pages(docs, used, settings, keep, found, args.scale, objects=spark.read.parquet(args.objects) if args.objects else None, **how)
    else:
        blocks = spark.read.parquet(args.blocks) if args.blocks else None
        objects = spark.read.parquet(args.objects) if args.objects else None
        out = pipeline.run(spark.read.parquet(args.input), blocks, used, settings, keep, objects=objects, **how)
    out.write(keep)
    if args.files:
        stem = spark.read.parquet(f"{args.out}/translated")
        stem = stem.groupBy("doc_id").agg(F.first("source_file").alias("stem")) if "source_file" in stem.columns else stem.select("doc_id", F.col("doc_id").cast("string").alias("stem")).distinct()
        named = lambda name: spark.read.parquet(f"{args.out}/{name}").join(stem, "doc_id")
        for name, column, file in (("base", "json", files.base_name(F.col("stem"))), ("translations", "json", files.translation_name(F.col("stem"), settings.target_lang)), ("markdown", "markdown", documents.markdown_name(F.col("stem")))):
            files.write_documents(named(name), file, column, args.files)


def main(argv: list[str] | None = None) -> None:
    from . import catalog, catalog_services  # noqa: F401

    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] in catalog.QUERIES:
        argv.insert(0, "query")
    parser = argparse.ArgumentParser(description=__doc__)
    modes = parser.add_subparsers(required=True)
    q = modes.add_parser("query")
    q.add_argument("query", choices=sorted(catalog.QUERIES))
    q.add_argument("folder")
    q.add_argument("--out")
    q.set_defaults(run=run_query)
    t = modes.add_parser("translate")
    t.add_argument("input", help="a table of paragraphs or, with --pages, a folder of page records")
    t.add_argument("out")
    t.add_argument("--pages", action="store_true")
    t.add_argument("--detections", help="with --pages: a table of a layout model's boxes")
    t.add_argument("--scale", type=float, default=1.0, help="pixels of the detections a point")
    t.add_argument("--page-range", help="page numbers from 0, such as 0,2,3")
    t.add_argument("--files", help="a folder for one file of each document, translation and Markdown")
    t.add_argument("--cache", help="a table of answers that outlives the run")
    t.add_argument("--run", dest="run_name", default="1", help="what this run is called in the cache")
    t.add_argument("--api-url")
    t.add_argument("--translate-all", action="store_true")
    t.add_argument("--translate-categories")
    t.add_argument("--markdown-mode", default="translated_only", choices=sorted(config_.MODES))
    t.add_argument("--no-metadata", action="store_true")
    t.add_argument("--translated-at", help="the time that front matter and translations state")
    t.add_argument("--heading-offset", type=int, default=0)
    t.add_argument("--markdown-include-all", action="store_true")
    t.add_argument("--markdown-skip")
    t.add_argument("--threshold", type=float, default=0.5)
    t.add_argument("--batch-size", type=int, default=20)
    t.add_argument("--max-concurrent", type=int)
    t.add_argument("--no-merge", action="store_true")
    for name, default in (("gap", 0.5), ("overlap", 0.7), ("font-size", 1.0), ("width", 0.95)):
        t.add_argument(f"--merge-{name}", type=float, default=default)
    t.add_argument("--no-extract-images", action="store_true")
    t.add_argument("--image-format", default="png", choices=["png", "jpeg"])
    t.add_argument("--image-quality", type=int, default=95)
    t.add_argument("--image-dpi", type=int, default=150)
    t.add_argument("--no-extract-tables", action="store_true")
    t.add_argument("--table-mode", default="heuristic", choices=["heuristic", "pdfplumber", "image"])
    t.add_argument("--side-by-side", choices=config_.ORDERS)
    t.add_argument("--side-by-side-gap", type=float, default=0.0)
    t.add_argument("--thumbnail", action="store_true")
    t.add_argument("--thumbnail-width", type=int, default=400)
    t.add_argument("--subsets", action="store_true", help="character sets of each document and style")
    t.add_argument("--llm-summary", action="store_true")
    t.add_argument("--llm-fallback", action="store_true")
    t.add_argument("--llm-provider", default="gemini")
    t.add_argument("--llm-model")
    t.add_argument("--llm-url", help="a chat service for summaries")
    t.add_argument("--llm-key-variable", default="LLM_KEY")
    t.add_argument("-v", "--verbose", action="store_true")
    t.add_argument("--blocks")
    t.add_argument("--objects", help="text objects of the pages, for tables")
    t.add_argument("--backend", default="mock", choices=["mock", "google", "deepl", "openai"])
    t.add_argument("--key-variable", default="TRANSLATION_KEY", help="the environment variable that holds the service's key")
    t.add_argument("--model", default="gpt-4o-mini")
    t.add_argument("--source", default="en")
    t.add_argument("--target", default="ja")
    t.add_argument("--strict", action="store_true")
    t.add_argument("--no-page-breaks", action="store_true")
    t.set_defaults(run=run_pipeline)
    args = parser.parse_args(argv)
    args.run(SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    main()
