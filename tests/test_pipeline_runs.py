"""The whole chain from page records, its summaries, options, counts and errors."""

import json

import pytest
from pyspark.sql import functions as F

from quirework import cli
from quirework.operators import documents, translate, translation_cache
from quirework.plans import config, metrics, pipeline
from quirework.sources import documents as sources


def page(*blocks, width=600, height=800):
    made = []
    for x0, y0, x1, y1, text in blocks:
        lines = [{"bbox": [x0, y0, x1, y1], "spans": [{"text": text, "font": {"size": 12, "name": "Times", "weight": 400, "flags": 0}}]}]
        made.append({"bbox": [x0, y0, x1, y1], "lines": lines})
    return {"bbox": [0, 0, width, height], "blocks": made}


def folder(tmp_path):
    (tmp_path / "in").mkdir()
    one = [page((50, 40, 300, 60, "A Title"), (50, 100, 300, 120, "An abstract."), (50, 140, 300, 160, "Body of one.")), page((50, 40, 300, 60, "More text."))]
    two = [page((50, 100, 300, 120, "Only text."), (50, 300, 300, 320, ""))]
    (tmp_path / "in" / "one.json").write_text(json.dumps(one))
    (tmp_path / "in" / "two.json").write_text(json.dumps(two))
    return str(tmp_path / "in")


def found(spark):
    boxes = [("one", 0, [("doc_title", 0.9, [80.0, 60.0, 620.0, 140.0]), ("abstract", 0.8, [80.0, 190.0, 620.0, 250.0]), ("text", 0.7, [80.0, 270.0, 620.0, 330.0])])]
    return spark.createDataFrame(boxes, "doc_id string, page_number int, boxes array<struct<label: string, score: double, coordinate: array<double>>>")


def keeper(spark, path):
    def keep(name, t):
        t.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    return keep


def answer(prompt):
    return '{"title": "Found", "abstract": "", "organization": "Here"}' if "JSON object" in prompt else "in short: " + str(len(prompt) > 0)


def test_page_records_to_documents(spark, tmp_path):
    docs = sources.read_pages(spark, folder(tmp_path)).withColumn("source_file", F.concat("doc_id", F.lit(".pdf")))
    settings = config.PipelineConfig(translated_at="now", model=config.ModelConfig(use_summary=True, use_fallback=True), thumbnail=config.ThumbnailConfig(width=300), side_by_side=config.SideBySideConfig(gap=10.0), subset=config.SubsetConfig())
    seen, tasks = [], []
    out = pipeline.run_pages(docs, translate.MockBackend(), settings, keeper(spark, tmp_path / "out"), found(spark), 2.0, ask=answer, progress=lambda s, i, n: seen.append((s, i, n)), tasks=lambda s, i, n: tasks.append((s, i, n)))
    out.write(keeper(spark, tmp_path / "out"))
    assert seen == [(s, i, 5) for i, s in enumerate(["categorize", "merge", "translate", "summary", "assemble"])]
    base = documents.read_base(out.base)
    assert {(r.doc_id, r.source_file, r.page_count) for r in base.collect()} == {("one", "one.pdf", 2), ("two", "two.pdf", 1)}
    summaries = {r.doc_id: r for r in documents.read_summaries(out.base).collect()}
    assert (summaries["one"].title, summaries["one"].abstract, summaries["one"].title_source, summaries["one"].organization) == ("A Title", "An abstract.", "layout", "Here")
    assert (summaries["two"].title, summaries["two"].abstract, summaries["two"].title_source, summaries["two"].abstract_source) == ("Found", None, "llm", "layout")
    assert summaries["one"].summary == "in short: True" and (summaries["one"].thumbnail_path, summaries["one"].thumbnail_width, summaries["one"].thumbnail_height) == ("one_thumbnail.png", 300, 400)
    told = {r.doc_id: r.asDict() for r in documents.read_summaries(out.translations, True).collect()}
    assert told["one"]["title"] == "[translated]A Title" and told["two"]["title"] == "[translated]Found" and told["two"]["abstract"] is None
    assert {r.base_file for r in documents.read_translations(out.translations).collect()} == {"one.json", "two.json"}
    text = {r.doc_id: r.markdown for r in out.markdown.collect()}
    assert "# A Title" in text["one"] and "[translated]Body of one." in text["one"] and "<!-- Page 2 -->" in text["one"] and text["one"].startswith("---\n")
    assert {(r.page_number, r.width, r.right_x, r.order) for r in out.side_by_side.collect()} == {(0, 1210.0, 610.0, "translated_original"), (1, 1210.0, 610.0, "translated_original")}
    assert all("[" in r.chars and len(r.cache_key) == 16 for r in out.subsets.collect())
    stats = out.stats.agg(*[F.sum(c).alias(c) for c in ("original", "final", "merged", "translated", "skipped")]).first().asDict()
    assert out.counts == {**stats, "failed": 0} and stats["original"] == 5
    assert {s for s, _, _ in tasks} >= {"merge", "translate", "summary", "markdown", "draw"} and all(0 <= i <= n for _, i, n in tasks)


def test_a_page_range_and_modes(spark, tmp_path):
    docs = sources.read_pages(spark, folder(tmp_path))
    settings = config.PipelineConfig(page_range=(1, 5, 6), mode="parallel", summary=False, metadata=False)
    out = pipeline.run_pages(docs.where("doc_id = 'one'"), translate.MockBackend(), settings, keeper(spark, tmp_path / "out"))
    assert out.markdown.first().markdown == "More text.\n[translated]More text.\n" and out.summaries is None
    with pytest.raises(ValueError, match="mode"):
        config.PipelineConfig(mode="both")
    with pytest.raises(ValueError, match="order"):
        config.SideBySideConfig("up")
    assert config.ModelConfig("openai").effective_model == "gpt-4o-mini" and config.ModelConfig("x", "y").effective_model == "y"


class Refusing(translate.MockBackend):
    name = "refusing"

    def translate_batch(self, texts, source, target):
        if any("Body" in t for t in texts):
            raise translate.ConfigurationError("no such key")
        return super().translate_batch(texts, source, target)


def test_errors_name_their_stage(spark, tmp_path):
    docs = sources.read_pages(spark, folder(tmp_path))
    with pytest.raises(metrics.PipelineError, match="no such key") as e:
        pipeline.run_pages(docs, Refusing(), config.PipelineConfig(), keeper(spark, tmp_path / "out"))
    assert e.value.stage == "translate"
    out = pipeline.run_pages(docs, translate.MockBackend(), config.PipelineConfig(summary=False), keeper(spark, tmp_path / "out"))
    out.draw = out.draw.withColumn("x", F.raise_error(F.lit("drawn badly")))
    with pytest.raises(metrics.PipelineError, match="drawn badly") as e:
        out.write(keeper(spark, tmp_path / "out"))
    assert e.value.stage == "draw"


def test_a_run_with_a_cache_goes_on(spark, tmp_path):
    docs = sources.read_pages(spark, folder(tmp_path))
    cache = translation_cache.TranslationCache(spark, f"{tmp_path}/cache")
    settings = config.PipelineConfig(summary=False, batch_size=1)
    out = pipeline.run_pages(docs, Refusing(), settings, keeper(spark, tmp_path / "a"), cache=cache)
    assert out.counts["failed"] == 1 and out.paragraphs.where("error_class = 'ConfigurationError'").count() == 1
    asked = cache.rows().count()
    good = Refusing()
    good.translate_batch = translate.MockBackend().translate_batch
    again = pipeline.run_pages(docs, good, settings, keeper(spark, tmp_path / "b"), cache=cache, run_name="2")
    assert again.counts["failed"] == 0 and cache.rows().count() == asked + 1


def test_paragraphs_that_are_not_merged(spark, tmp_path):
    docs = sources.read_pages(spark, folder(tmp_path))
    out = pipeline.run_pages(docs, translate.MockBackend(), config.PipelineConfig(merge_adjacent=False, summary=False), keeper(spark, tmp_path / "out"))
    assert out.counts["merged"] == 0 and out.paragraphs.count() == out.counts["original"] == 5


def test_command_line_from_page_records(spark, tmp_path):
    boxes = str(tmp_path / "boxes")
    found(spark).write.parquet(boxes)
    out = str(tmp_path / "out")
    cli.main(["translate", folder(tmp_path), out, "--pages", "--detections", boxes, "--scale", "2", "--files", f"{tmp_path}/files", "--markdown-mode", "original_only", "--side-by-side", "original_translated", "--cache", f"{tmp_path}/cache", "--heading-offset", "1", "--translate-categories", "text, abstract,"])
    base = spark.read.parquet(f"{out}/base")
    assert {(r.doc_id, r.source_file) for r in documents.read_base(base).collect()} == {("one", "one.pdf"), ("two", "two.pdf")}
    assert {r.doc_id: r.title for r in documents.read_summaries(base).collect()} == {"one": "A Title", "two": None}
    assert {r.base_file for r in documents.read_translations(spark.read.parquet(f"{out}/translations")).collect()} == {"one.json", "two.json"}
    assert (tmp_path / "files" / "one.md").read_text().startswith("## A Title") and json.loads((tmp_path / "files" / "one.ja.json").read_text())["base_file"] == "one.json"
    assert (tmp_path / "files" / "two.json").read_text() == {r.doc_id: r.json for r in base.collect()}["two"]
    with pytest.raises(SystemExit):
        cli.main(["translate", "x", out, "--llm-summary"])
