import math

import pytest
from pyspark.sql import functions as F

from quirework.functions import geometry as g
from quirework.operators import categories, extract, markdown, match, merge, tables
from quirework.plans import pipeline
from quirework.operators import translate

PARAGRAPH = "doc_id long, id string, page_number int, text string, x0 double, y0 double, x1 double, y1 double, line_count int, original_font_size double, category string, category_confidence double, is_bold boolean, is_italic boolean, input_pos int"


def para(pos, x0, y0, x1, y1, text=None, category="text", page=0, size=12.0, conf=0.9, doc=1, bold=False, italic=False):
    return (doc, f"p{pos}", page, text or f"t{pos}", float(x0), float(y0), float(x1), float(y1), 1, size, category, conf, bold, italic, pos)


def frame(spark, rows):
    return spark.createDataFrame(rows, PARAGRAPH)


def evaluate(spark, text, a, b):
    box = lambda v: F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("x0", "y0", "x1", "y1"), v)])
    return spark.range(1).select(box(a).alias("a"), box(b).alias("b")).select(F.expr(text)).first()[0]


def test_boxes(spark):
    contained = g.containment("a", "b")
    assert evaluate(spark, g.intersection_area("a", "b"), (0, 0, 50, 50), (50, 0, 90, 50)) == 0
    assert evaluate(spark, contained, (0, 0, 100, 100), (50, 50, 150, 150)) == 0.25
    assert evaluate(spark, contained, (0, 0, 0, 10), (0, 0, 50, 50)) == 0
    overlap = g.x_overlap("a", "b")
    assert evaluate(spark, overlap, (0, 0, 100, 1), (80, 0, 180, 1)) == 0.2
    assert evaluate(spark, overlap, (0, 0, 300, 1), (100, 0, 150, 1)) == 1
    assert evaluate(spark, overlap, (10, 0, 10, 1), (0, 0, 50, 1)) == 0


def test_category_rules(spark):
    rows = spark.createDataFrame([(c,) for c in (None, "text", "header", "nonsense", "image", "page_number")], "c string")
    c = F.col("c")
    got = {r[0]: tuple(r)[1:] for r in rows.select(c, categories.translatable(c), categories.skipped(c), categories.element(c), categories.priority(c), categories.skipped(c, ())).collect()}
    assert got[None] == (True, False, "p", 99, False) and got["text"] == (True, False, "p", 6, False)
    assert got["header"] == (False, True, "p", 8, False) and got["nonsense"] == (False, False, "p", 99, False)
    assert got["image"][2:4] == ("image", 4) and got["page_number"][1]
    assert categories.parse_filter("a, ,b") == ("a", "b") and len(categories.parse_filter("all")) == 26 and categories.parse_filter(None) == categories.TRANSLATABLE
    assert categories.dimension(spark).count() == 26


BLOCK = "doc_id long, page_number int, block_id string, raw_category string, x0 double, y0 double, x1 double, y1 double, confidence double, block_pos long"


def test_best_block_wins(spark):
    p = frame(spark, [para(0, 0, 0, 100, 100), para(1, 200, 0, 300, 100), para(2, 0, 0, 100, 100, page=1)])
    blocks = spark.createDataFrame(
        [(1, 0, "a", "text", 0.0, 0.0, 100.0, 100.0, 0.5, 0), (1, 0, "b", "inline_formula", 0.0, 0.0, 100.0, 100.0, 0.6, 1), (1, 0, "c", "text", 250.0, 50.0, 350.0, 150.0, 0.7, 2)], BLOCK
    )
    got = {r.id: (r.category, r.layout_block_id, r.category_confidence) for r in match.assign_categories(p, blocks).collect()}
    assert got == {"p0": ("inline_formula", "b", 0.6), "p1": (None, None, None), "p2": (None, None, None)}
    objects = {r.id: r.category for r in match.match_text_objects(p, blocks).collect()}
    assert objects == {"p0": "inline_formula", "p1": "unknown", "p2": "unknown"}
    small = spark.createDataFrame([(1, 0, "a", "text", -50.0, -50.0, 150.0, 150.0, 0.5, 0), (1, 0, "b", "abstract", 0.0, 0.0, 100.0, 100.0, 0.5, 1)], BLOCK)
    assert {r.id: r.category for r in match.match_text_objects(p, small).collect()}["p0"] == "abstract"


def texts(df):
    return [r.text for r in df.orderBy("doc_id", "page_number", "out_pos").collect()]


@pytest.mark.parametrize(
    "second, merged",
    [
        (para(1, 0, 60, 400, 98), True), (para(1, 0, 10, 400, 50), False), (para(1, 0, 60, 400, 101), False), (para(1, 0, 60, 400, 98, size=16.0), False),
        (para(1, 0, 60, 150, 98), False), (para(1, 0, 60, 390, 98), True), (para(1, 0, 60, 400, 98, category=None), False), (para(1, 0, 60, 400, 98, category="abstract"), False),
    ],
)
def test_merge_rule(spark, second, merged):
    got = texts(merge.merge_paragraphs(frame(spark, [para(0, 0, 100, 400, 150), second])))
    assert got == (["t0\nt1"] if merged else ["t0", "t1"])


def test_merge_chain_titles_and_order(spark):
    chain = [para(0, 0, 100, 400, 150, "First"), para(1, 0, 50, 400, 98, "second", conf=None), para(2, 0, 0, 400, 48, "third", conf=0.4)]
    out = merge.merge_paragraphs(frame(spark, chain)).collect()
    assert [(r.text, r.id, r.line_count, r.y0, r.y1, r.category_confidence) for r in out] == [("First\nsecond\nthird", "p0", 3, 0.0, 150.0, 0.4)]
    assert texts(merge.merge_paragraphs(frame(spark, chain[::-1]))) == ["First\nsecond\nthird"]
    split = [para(0, 0, 100, 400, 150), para(1, 0, 80, 400, 98, category="doc_title"), para(2, 0, 50, 400, 78)]
    assert len(texts(merge.merge_paragraphs(frame(spark, split)))) == 3
    pages = [para(0, 0, 100, 400, 150, page=1), para(1, 0, 100, 400, 150, page=0)]
    assert texts(merge.merge_paragraphs(frame(spark, pages))) == ["t1", "t0"]


def test_columns(spark):
    rows = [para(0, 50, 500, 300, 600), para(1, 350, 500, 600, 600), para(2, 50, 400, 300, 498), para(3, 350, 400, 600, 498), para(4, 0, 700, 640, 720)]
    got = {r.id: r.col for r in merge.detect_columns(frame(spark, rows)).collect()}
    assert got == {"p0": 0, "p2": 0, "p1": 1, "p3": 1, "p4": 0}
    assert sorted(len(t.split("\n")) for t in texts(merge.merge_paragraphs(frame(spark, rows[:4])))) == [2, 2]
    wide = {r.id: r.col for r in merge.detect_columns(frame(spark, [para(0, 0, 0, 90, 10), para(1, 0, 20, 100, 30)])).collect()}
    assert wide == {"p0": 0, "p1": 0}


def test_markdown_page_breaks_come_before_skipping(spark):
    rows = [para(0, 0, 0, 1, 1, "a"), para(1, 0, 0, 1, 1, "gone", "header", page=1), para(2, 0, 0, 1, 1, "b", page=1)]
    got = markdown.documents(frame(spark, rows), markdown.MarkdownConfig(mode="original")).first().markdown
    assert got == "a\n\n\n---\n<!-- Page 2 -->\n\nb\n"
    every = markdown.documents(frame(spark, rows), markdown.MarkdownConfig(mode="original", skip=(), page_breaks=False)).first().markdown
    assert every == "a\n\ngone\n\nb\n"


def test_markdown_styles_and_kinds(spark):
    rows = [
        para(0, 0, 0, 1, 1, "T", "doc_title"), para(1, 0, 0, 1, 1, "b", bold=True), para(2, 0, 0, 1, 1, "i", italic=True), para(3, 0, 0, 1, 1, "x", bold=True, italic=True),
        para(4, 0, 0, 1, 1, "f", "inline_formula"), para(5, 0, 0, 1, 1, "g", "algorithm"), para(6, 0, 0, 1, 1, "c", "figure_title"), para(7, 0, 0, 1, 1, "q\nr", "aside_text"), para(8, 0, 0, 1, 1, "", "text"), para(9, 0, 0, 1, 1, "im", "image"),
    ]
    got = markdown.documents(frame(spark, rows).withColumn("text", F.when(F.col("input_pos") == 8, "").otherwise(F.col("text"))), markdown.MarkdownConfig(mode="original", heading_offset=1, skip=())).first().markdown
    assert got == "## T\n\n**b**\n\n*i*\n\n***x***\n\n`f`\n\n```\ng\n```\n\n*c*\n\n> q\n> r\n"


def test_markdown_assets(spark):
    rows = [para(0, 0, 0, 1, 1, "x", "image"), para(1, 0, 0, 1, 1, "y", "image"), para(2, 5, 0, 9, 1, "tab", "table"), para(3, 7, 0, 9, 1, "plain", "table")]
    keyed = frame(spark, rows).withColumn("layout_block_id", F.when(F.col("input_pos") < 2, "k").otherwise(""))
    images = spark.createDataFrame([(1, "k", 0, 0.0, 0.0, 1.0, 1.0, "old.png", 0), (1, "k", 0, 0.0, 0.0, 1.0, 1.0, "new.png", 1)], "doc_id long, layout_block_id string, page_number int, x0 double, y0 double, x1 double, y1 double, relative_path string, input_pos int")
    grids = spark.createDataFrame([(1, None, 0, 5.0, 0.0, 9.0, 1.0, "| t |", 0)], "doc_id long, layout_block_id string, page_number int, x0 double, y0 double, x1 double, y1 double, markdown string, input_pos int")
    got = markdown.documents(keyed, markdown.MarkdownConfig(mode="original"), images, grids).first().markdown
    assert got == "![Image](new.png)\n\n| t |\n\nplain\n"


def test_markdown_translated_and_parallel(spark):
    rows = frame(spark, [para(0, 0, 0, 1, 1, "a", "doc_title"), para(1, 0, 0, 1, 1, "b"), para(2, 0, 0, 1, 1, "c", "algorithm")]).withColumn("translated_text", F.when(F.col("input_pos") == 1, "").otherwise(F.concat(F.lit("T"), "text")))
    config = markdown.MarkdownConfig(metadata={"title": "x", "target_lang": "ja"}, translated_at="now")
    assert markdown.documents(rows, config).first().markdown == "---\ntitle: x\ntarget_lang: ja\ntranslated_at: now\n---\n\n# Ta\n\nb\n\n```\nTc\n```\n"
    assert markdown.documents(rows, markdown.MarkdownConfig(mode="parallel")).first().markdown == "# a\n# Ta\n\nb\n\n```\nc\n```\nTc\n"


GRID = "table_id long, pos long, text string, x0 double, y0 double, x1 double, y1 double"


def test_table_grid(spark):
    at = [("A | B", 0, 100, 40), ("n", 100, 103, 20), ("x<y", 1, 80, 40), ("1", 102, 79, 20), ("2", 112, 79, 5)]
    objects = spark.createDataFrame([(1, i, t, float(x), float(y), float(x + w), float(y + 9)) for i, (t, x, y, w) in enumerate(at)], GRID)
    bounds = [(r.left, r.right) for r in tables.column_bounds(objects).orderBy("col").collect()]
    assert bounds == [(-5.0, 50.5), (50.5, 212.0)]
    cells = tables.cells(objects)
    assert [(r.row, r.col, r.text, r.is_header) for r in cells.orderBy("row", "col").collect()] == [(0, 0, "A | B", True), (0, 1, "n", True), (1, 0, "x<y", False), (1, 1, "1 2", False)]
    assert tables.to_markdown(cells).first().markdown == "| A \\| B | n |\n| --- | --- |\n| x<y | 1 2 |"
    html = tables.to_html(cells).first().html
    assert html.startswith("<table>\n  <tr>\n    <th>A | B</th>") and "<td>x&lt;y</td>" in html
    assert [tables.methods(cells, *a).first().method for a in (("heuristic",), ("pdfplumber", True), ("pdfplumber",), ("image",))] == ["heuristic", "pdfplumber", "heuristic", "image"]


def span(text, size=12.0, weight=400, name="Helvetica", flags=0, rotation=0.0):
    return (text, rotation, (size, weight, name, flags))


def pages(spark, *docs):
    return spark.createDataFrame([(i, d) for i, d in enumerate(docs)], f"doc_id long, pages {extract.PAGES}")


def page(*blocks, height=800.0):
    return ([0.0, 0.0, 600.0, height], None, list(blocks))


def block(lines, bbox=(10.0, 20.0, 100.0, 40.0)):
    return (list(bbox), [(list(b) if b else None, spans) for b, spans in lines])


def test_extraction(spark):
    doc = [page(block([((10.0, 20.0, 100.0, 30.0), [span("Hello")]), ((10.0, 30.0, 100.0, 40.0), [span("wor"), span("ld　\n")])]), block([((0.0, 0.0, 1.0, 1.0), [span("  ")])]))]
    r = extract.paragraphs(pages(spark, doc)).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.text, r.x0, r.y0, r.x1, r.y1, r.line_count, r.original_font_size, r.id, r.text_color) == ("Hello world", 10.0, 760.0, 100.0, 780.0, 2, 12.0, "para_p0_b0", None)


@pytest.mark.parametrize(
    "spans, field, want",
    [
        ([span("AA", 10.0), span("BBBBB", 12.0)], "original_font_size", 12.0), ([span("AA", 10.0), span("BB", 12.0)], "original_font_size", 10.0), ([span("AA", None)], "original_font_size", 12.0),
        ([span("A", weight=700)], "is_bold", True), ([span("A", name="Helvetica-Bold")], "is_bold", True), ([span("A", weight=700), span("B")], "is_bold", False),
        ([span("A", flags=64)], "is_italic", True), ([span("A", name="Times-Italic")], "is_italic", True),
        ([span("AB"), span("CDEFGHIJ", name="Times-Roman")], "font_name", "Times-Roman"), ([span("AB", name="Z"), span("CD", name="A")], "font_name", "Z"), ([span("A", rotation=math.pi / 2)], "rotation", 90.0),
    ],
)
def test_extracted_style(spark, spans, field, want):
    got = extract.paragraphs(pages(spark, [page(block([((10.0, 20.0, 100.0, 30.0), spans)]))])).first()[field]
    assert got == pytest.approx(want)


@pytest.mark.parametrize(
    "edges, want",
    [
        ([(60, 140), (70, 130)], "center"), ([(10, 200)] * 3, "justify"), ([(30, 180), (10, 190), (10, 170), (10, 185)], "left"), ([(10, 200), (40, 200), (80, 201)], "right"),
        ([(80, 120)], "center"), ([(50, 80)], "left"), ([], "left"), ([(10, 100), (50, 180)], "left"),
    ],
)
def test_alignment(spark, edges, want):
    doc = [page(block([((float(a), 0.0, float(b), 9.0), [span("x")]) for a, b in edges] or [(None, [span("x")])], (50.0, 0.0, 150.0, 50.0)))]
    assert extract.paragraphs(pages(spark, doc)).first().alignment == want


def test_page_range(spark):
    two = [page(block([((0.0, 0.0, 1.0, 1.0), [span(t)])])) for t in ("a", "b")]
    df = pages(spark, two)
    assert [(r.page_number, r.text) for r in extract.paragraphs(df, [1]).collect()] == [(1, "b")]
    assert sorted((r.page_number, r.text) for r in extract.paragraphs(df, [4, 7]).collect()) == [(4, "a"), (7, "b")]


def test_detections_and_objects(spark):
    df = spark.createDataFrame([(1, 0, [("text", 0.9, [0.0, 0.0, 100.0, 100.0]), ("odd", 0.5, [0.0, 0.0, 1.0, 1.0]), ("text", 0.5, [1.0])])], "doc_id long, page_number int, boxes array<struct<label string, score double, coordinate array<double>>>")
    got = extract.detections(df, ["text"], 1.0, 800.0).orderBy("raw_category").collect()
    assert [(r.raw_category, r.y0, r.y1) for r in got] == [("text", 700.0, 800.0), ("unknown", 799.0, 800.0)]
    texts_ = spark.createDataFrame([(1, 0, [" a ", "\x00", "b\tc"])], "doc_id long, page_number int, texts array<string>")
    assert [(r.id, r.text) for r in extract.text_objects(texts_).collect()] == [("text_p0_i0", "a"), ("text_p0_i1", "b c")]


def test_pipeline(spark):
    p = frame(spark, [para(0, 0, 100, 400, 150, "one"), para(1, 0, 50, 400, 98, "two"), para(2, 0, 160, 400, 190, "Title", "doc_title")])
    seen = []
    out = pipeline.run(p, None, translate.MockBackend(), pipeline.PipelineConfig(), lambda n, df: df, lambda stage, i, n: seen.append(stage))
    assert out.markdown.first().markdown == "# Title\n\n[translated]one\ntwo\n"
    assert out.stats.first().asDict() == {"doc_id": 1, "original": 3, "final": 2, "merged": 1, "translated": 1, "skipped": 1}
    assert out.draw.count() >= 1 and out.base.count() == 1 and out.translations.count() == 1 and seen == ["categorize", "merge", "translate", "summary", "assemble"]
    with pytest.raises(pipeline.PipelineError):
        pipeline.run(p.drop("x0"), None, translate.MockBackend(), pipeline.PipelineConfig(), lambda n, df: df)


def test_fit_is_brute_force_over_sizes():
    import random

    from quirework.operators import fit

    rng, config = random.Random(0), fit.FitConfig()
    fonts = (fit.Font(), fit.Font({" ": 0.25, **{c: 0.2 + (ord(c) % 7) / 8 for c in "abcimw."}}, default=0.0, cjk=0.0))
    for n in range(400):
        font = fonts[n % 2]
        text = "".join(rng.choice("abcimw .      漢字かな。（」\n") for _ in range(rng.randrange(0, 200)))
        w, h, size = rng.choice([15.0, 100.0, 230.0]), rng.choice([5.0, 40.0, 90.0, 300.0]), rng.choice([5.0, 10.0, 12.5])
        want, s = None, size
        while text and s >= config.smallest and want is None:
            lines = fit.wrap_lines(text, w, font, s)
            tall = font.line_height(s) * (len(lines) - lines.count(fit.BREAK) + config.break_factor * lines.count(fit.BREAK))
            if not lines:
                break
            if tall <= h:
                want = (s, True, lines)
            s = round(s - config.step, 2)
        got = fit.fit_text(text, w, h, size, font, config)
        if not text:
            assert got == (size, True, 0.0, [])
        else:
            assert (got[0], got[1], got[3]) == (want or (config.smallest, False, fit.wrap_lines(text, w, font, config.smallest)))


def test_glyph_font(spark):
    from quirework.operators import fit

    rows = spark.createDataFrame([(97, 0.5), (97, 0.25), (128512, 1.5), (None, 1.0), (98, None)], "code int, width double")
    font = fit.glyph_font(rows)
    assert [font.width(c, 2.0) for c in ("a", "aa", "b", "漢", "😀", "😁", "")] == [1.0, 2.0, 0.0, 0.0, 3.0, 0.0, 0.0]
    import pytest

    with pytest.raises(ValueError):
        fit.glyph_font(rows, most=1)


def test_merged_paragraphs_keep_the_first_ones_style(spark):
    from quirework.operators import drawing, merge

    rows = [(1, 0, f"p{i}", f"line {i}", 10.0, 100.0 - 12 * i, 200.0, 110.0 - 12 * i, 1, 10.0, "text", 0.9, False, False, i, 90.0 + i, "center", f"b{i}", f"f{i}", {"k": i}) for i in range(2)]
    names = "doc_id long, page_number int, id string, text string, x0 double, y0 double, x1 double, y1 double, line_count int, original_font_size double, category string, category_confidence double, is_bold boolean, is_italic boolean, input_pos int, rotation double, alignment string, layout_block_id string, font_name string, extra_map map<string,int>"
    df = spark.createDataFrame(rows, names).drop("extra_map")
    (got,) = merge.merge_paragraphs(df).collect()
    assert (got.text, got.rotation, got.alignment, got.layout_block_id, got.font_name) == ("line 0\nline 1", 90.0, "center", "b0", "f0")
    plan = drawing.draw_plan(merge.merge_paragraphs(df).withColumn("translated_text", got_text(df)))
    assert {round(r.x, 3) for r in plan.collect()} and all(r.x < 200 for r in plan.collect())
    import pytest

    with pytest.raises(ValueError):
        drawing.draw_plan(df.drop("rotation"))


def got_text(df):
    from pyspark.sql import functions as F

    return F.lit("a b")


def test_pipeline_draws_turned_text(spark, tmp_path):
    from quirework.operators import translate
    from quirework.plans import pipeline

    rows = [(1, 0, "p0", "some words", 10.0, 10.0, 30.0, 400.0, 1, 10.0, "text", 0.9, False, False, 0, 90.0, "center")]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, id string, text string, x0 double, y0 double, x1 double, y1 double, line_count int, original_font_size double, category string, category_confidence double, is_bold boolean, is_italic boolean, input_pos int, rotation double, alignment string")

    def keep(name, t):
        t.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    out = pipeline.run(df, None, translate.MockBackend(), pipeline.PipelineConfig(), keep)
    lines = out.draw.collect()
    assert len(lines) == 1 and lines[0].y < 390  # one turned, centred line down the box


def test_extraction_shuffles_nothing(spark):
    from quirework.operators import extract

    pages = spark.createDataFrame([], f"doc_id long, pages {extract.PAGES}")
    plan = extract.paragraphs(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_pipeline_writes_tables_and_images(spark, tmp_path):
    from quirework.operators import assets, translate
    from quirework.plans import pipeline

    names = "doc_id long, page_number int, id string, text string, x0 double, y0 double, x1 double, y1 double, line_count int, original_font_size double, category string, category_confidence double, is_bold boolean, is_italic boolean, input_pos int"
    p = [(1, 0, "p0", "Words here", 50.0, 700.0, 300.0, 720.0), (1, 0, "p1", "a b c d", 50.0, 500.0, 300.0, 600.0), (1, 0, "p2", "x", 50.0, 300.0, 300.0, 400.0), (1, 0, "p3", "lone", 50.0, 100.0, 300.0, 200.0)]
    paragraphs = spark.createDataFrame([(*r, 1, 10.0, None, None, False, False, i) for i, r in enumerate(p)], names)
    kinds = ("text", "table", "image", "table")
    blocks = spark.createDataFrame([(1, 0, f"b{i}", k, *r[4:], 0.9, i) for i, (k, r) in enumerate(zip(kinds, p))], "doc_id long, page_number int, block_id string, raw_category string, x0 double, y0 double, x1 double, y1 double, confidence double, block_pos long")
    at = [(60.0, 580.0, "h1"), (160.0, 580.0, "h|2"), (60.0, 540.0, "v1"), (160.0, 540.0, "v2"), (60.0, 150.0, "lone"), (400.0, 150.0, "outside")]
    objects = spark.createDataFrame([(1, 0, i, t, x, y, x + 40, y + 9) for i, (x, y, t) in enumerate(at)], "doc_id long, page_number int, pos long, text string, x0 double, y0 double, x1 double, y1 double")
    found = {r.layout_block_id: (r.method, r.markdown) for r in assets.page_tables(blocks, objects).collect()}
    assert found == {"b1": ("heuristic", "| h1 | h\\|2 |\n| --- | --- |\n| v1 | v2 |"), "b3": ("image", None)}

    def keep(name, t):
        t.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    seen = []
    out = pipeline.run(paragraphs, blocks, translate.MockBackend(), pipeline.PipelineConfig(), keep, lambda s, i, n: seen.append(s), objects=objects)
    assert out.markdown.first().markdown == "[translated]Words here\n\n| h1 | h\\|2 |\n| --- | --- |\n| v1 | v2 |\n\n![Image](images/image_001.png)\n\n![Table](images/table_001.png)\n"
    assert seen == ["categorize", "merge", "translate", "tables", "summary", "assemble"]


def test_cells_with_spans(spark):
    from quirework.operators import tables

    rows = [("t", 0, 0, "a<", True, 1, 2, "center"), ("t", 1, 0, "b", False, None, None, None), ("t", 1, 1, "c", False, 2, 1, "right"), ("u", 0, 0, "x", True, 1, 1, "left")]
    cells = spark.createDataFrame(rows, "table_id string, row int, col int, text string, is_header boolean, rowspan int, colspan int, alignment string")
    html = {r.table_id: r.html for r in tables.to_html(cells).collect()}
    assert html["t"] == '<table>\n  <tr>\n    <th colspan="2" style="text-align: center">a&lt;</th>\n  </tr>\n  <tr>\n    <td>b</td>\n    <td rowspan="2" style="text-align: right">c</td>\n  </tr>\n</table>'
    assert {r.table_id: r.markdown for r in tables.to_markdown(cells).collect()}["t"] == "| a< |  |\n| :---: | --- |\n| b | c |"
    assert {r.table_id: r.is_complex for r in tables.complex_merges(cells).collect()} == {"t": True, "u": False}


def test_pages_from_files(spark, tmp_path):
    from quirework.operators import extract
    from quirework.sources import documents as sources

    (tmp_path / "one.json").write_text('[{"bbox": [0, 0, 600, 800], "blocks": [{"bbox": [10, 20, 100, 40], "lines": [{"bbox": [10, 20, 100, 30], "spans": [{"text": "Hello", "font": {"size": 12}}]}, {"bbox": [10, 30, 100, 40], "spans": [{"text": "world"}]}]}]}]')
    (r,) = extract.paragraphs(sources.read_pages(spark, str(tmp_path))).collect()
    assert (r.doc_id, r.id, r.text, r.y0, r.y1, r.line_count, r.original_font_size) == ("one", "para_p0_b0", "Hello world", 760.0, 780.0, 2, 12.0)
