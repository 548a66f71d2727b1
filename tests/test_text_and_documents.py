import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirework import cli
from quirework.functions import text as t
from quirework.operators import backends, chunking, detect, documents, drawing, evaluate, fit, geometry, splitting, summary, translate
from quirework.sources import documents as sources
from quirework.streaming import landing


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("text, want", [("hello\tworld", "hello world"), ("hello\x00world", "helloworld"), ("auto\x02gen", "auto-gen"), ("so­ft", "so-ft"), ("a\nbÿc\x7f", "a bc")])
def test_controls(spark, text, want):
    assert one(spark, t.normalise_controls, text) == want


def test_text_functions(spark):
    assert one(spark, lambda x: t.normalise_controls(x, True), "a\tb\nc\r") == "a b\nc"
    assert one(spark, t.collapse, "　 a \x1c b\n") == "a b"
    assert one(spark, t.ascii_fallback, "α≤β…—×") == "alpha<=beta...--x"
    assert one(spark, t.escape_cell, " a|b\nc ") == "a\\|b<br>c"
    assert one(spark, t.escape_html, '<a href="x">&</a>') == "&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;"
    assert one(spark, t.compare_key, "a\tb  c­") == "ab c"
    assert [one(spark, t.token_count, x) for x in ("", "abc")] == [0, 3]


@given(st.text(alphabet="ab .!?。\n", max_size=200), st.integers(1, 30))
@settings(max_examples=200, deadline=None)
def test_split_parts_are_the_text(text, most):
    parts = splitting.split_long_text(text, most)
    assert "".join(parts) == text and all(len(p) <= most for p in parts)


def test_split_rules():
    assert splitting.split_long_text("a" * 100, 30)[0] == "a" * 30
    assert splitting.split_long_text("One. Two. three four", 12) == ["One. Two. ", "three four"]
    assert splitting.split_long_text("abcdefgh ijkl", 10) == ["abcdefgh ", "ijkl"]
    assert splitting.split_long_text("", 5) == [""]


def test_split_and_rejoin_tables(spark):
    df = spark.createDataFrame([(1, "a1. a2."), (2, "b")], "k long, text string")
    parts = splitting.split_texts(df, "k", 4)
    assert sorted((r.k, r.part_no, r.part, r.parts) for r in parts.collect()) == [(1, 0, "a1. ", 2), (1, 1, "a2.", 2), (2, 0, "b", 1)]
    assert {r.k: r.text for r in splitting.rejoin(parts, "k", "ko").collect()} == {1: "a1.  a2.", 2: "b"}
    assert {r.k: r.text for r in splitting.rejoin(parts, "k", "JA").collect()} == {1: "a1. a2.", 2: "b"}
    assert splitting.split_texts(df, "k", None).count() == 2


def test_chunks(spark):
    df = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([20, 20, 20, 90, 20, 0, 1])], "d long, i int, text string")
    got = [r.chunk for r in chunking.by_weight(df, ["d"], "i", "length(text)", 50, 20).orderBy("i").collect()]
    assert got == [0, 0, 1, 2, 3, 3, 3]
    assert [r.chunk for r in chunking.by_weight(df, ["d"], "i", "length(text)", 500, 2).orderBy("i").collect()] == [0, 0, 1, 1, 2, 2, 3]
    assert [r.chunk for r in chunking.by_number(df, ["d"], "i", 3).orderBy("i").collect()] == [0, 0, 0, 1, 1, 1, 2]


class Odd:
    """Returns too few texts for batches over ``most``, and fails ``fails`` times first."""

    name, max_text_length = "odd", None

    def __init__(self, most=10, fails=0):
        self.most, self.fails, self.calls = most, fails, 0

    def translate_batch(self, texts, source, target):
        self.calls += 1
        if self.fails:
            self.fails -= 1
            raise translate.TranslationError("again")
        return [f"T{x}" for x in texts][: self.most if len(texts) > self.most else None]


def test_retries_and_mismatches():
    waits = []
    assert translate.translate_all(Odd(fails=2), ["a", " ", "b"], "en", "ja", sleep=waits.append) == ["Ta", " ", "Tb"] and waits == [1.0, 2.0]
    with pytest.raises(translate.TranslationError):
        translate.translate_all(Odd(fails=9), ["a"], "en", "ja", sleep=waits.append)
    assert translate.translate_all(Odd(most=2), list("abcde"), "en", "ja") == ["Ta", "Tb", "Tc", "Td", "Te"]
    assert translate.translate_all(Odd(most=0), ["a", "b"], "en", "ja") == ["a", "b"]
    with pytest.raises(translate.LengthMismatch):
        translate.translate_all(Odd(most=0), ["a", "b"], "en", "ja", strict=True)
    assert not issubclass(translate.QuotaError, translate.TranslationError) and not issubclass(translate.ConfigurationError, translate.TranslationError)
    assert list(translate.batches(["aa", "bb", "cc"], 2, 3)) == [["aa"], ["bb"], ["cc"]]


def test_translate_table(spark):
    rows = [(1, "a", "text", "One. Two."), (1, "b", "table", "x"), (1, "c", None, " "), (1, "d", "text", None)]
    df = spark.createDataFrame(rows, "doc_id long, id string, category string, text string")
    got = {r.id: r.translated_text for r in translate.translate_paragraphs(df, translate.MockBackend(5), "en", "de").collect()}
    assert got == {"a": "[translated]One.  [translated]Two.", "b": None, "c": " ", "d": None}
    limits = translate.with_limit(spark.createDataFrame([("gpt-4o-mini-1",), ("gpt-4",), ("x",)], "m string"), F.col("m"), {"gpt-4": 1, "gpt-4o": 2, "gpt-4o-mini": 3}, 9, "n")
    assert [r.n for r in limits.collect()] == [3, 1, 9]


def test_backends():
    sent = []

    def send(url, body, headers):
        sent.append(body.decode())
        return 200, json.dumps({"translations": [{"text": "x"}] * body.decode().count("text=")})

    assert backends.FormBackend("u", "k", send=send).translate_batch(["a"] * 51, "auto", "ja") == ["x"] * 51
    assert len(sent) == 2 and "source_lang" not in sent[0] and "target_lang=JA" in sent[0]
    for status, error in ((403, translate.ConfigurationError), (456, translate.QuotaError), (500, translate.TranslationError)):
        with pytest.raises(error):
            backends.FormBackend("u", "k", send=lambda *a, s=status: (s, "")).translate_batch(["a"], "en", "ja")
    items = [{"index": i, "translation": str(i)} for i in (2, 0, 1)]
    assert backends.restore_order(items, 3) == ["0", "1", "2"]
    for bad in (items[:2], [*items[:2], items[0]]):
        with pytest.raises(translate.LengthMismatch):
            backends.restore_order(bad, 3)
    reply = json.dumps({"choices": [{"message": {"content": "```json\n" + json.dumps({"translations": items}) + "\n```"}}]})
    assert backends.ChatBackend("u", "k", "m", send=lambda *a: (200, reply)).translate_batch(["a", "b", "c"], "en", "ja") == ["0", "1", "2"]
    assert backends.extract_json("nothing") is None and backends.summary_content("a![x](y)b", 1) == "a"
    assert "English to xx" in backends.prompt(["a"], "en", "xx")


def test_fitting():
    font = fit.Font(widths={}, default=0.5)
    assert fit.wrap_lines("aaa bbb ccc", 40, font, 10) == ["aaa bbb", "ccc"]
    assert fit.wrap_lines("aaaaaaaaaa", 20, font, 10) == ["aaaa", "aaaa", "aa"]
    assert fit.wrap_lines("a\n\nb\n", 40, font, 10) == ["a", fit.BREAK, fit.BREAK, "b"]
    assert fit.wrap_lines("漢字漢。字", 30, font, 10) == ["漢字漢。", "字"] and fit.wrap_lines("漢字（漢字", 30, font, 10) == ["漢字", "（漢字"]
    assert fit.wrap_lines("漢", 1, font, 10) == ["漢"] and fit.wrap_lines("", 10, font, 10) == []
    assert fit.fit_text("", 1, 1, 9.0, font) == (9.0, True, 0.0, [])
    size, fits, tall, lines = fit.fit_text("aaa bbb ccc", 40, 20, 10.0, font)
    assert fits and size < 10 and tall <= 20
    assert fit.fit_text("aaa " * 50, 10, 10, 10.0, font)[:2] == (6.0, False)


@given(st.text(alphabet="ab 漢。（\n", max_size=60), st.integers(5, 60))
@settings(max_examples=150, deadline=None)
def test_wrapping_keeps_the_characters(text, width):
    lines = fit.wrap_lines(text, width, fit.Font(), 10)
    assert "".join("".join(lines).replace(fit.BREAK, "").split()) == "".join(text.split())


def test_placement(spark):
    rows = [(0.0, "right", 100.0, 80.0), (90.0, "left", 10.0, 100.0), (270.0, "center", 90.0, 25.0)]
    df = spark.createDataFrame([(0.0, 0.0, 110.0, 100.0, 10.0 if r == 0 else 50.0, 80.0 if r == 0 else 90.0, r, a) for r, a, _, _ in rows], "x0 double, y0 double, x1 double, y1 double, width double, y_position double, rotation double, alignment string")
    got = [(r.x, r.y) for r in fit.place_lines(df).collect()]
    assert got == [(100.0, 80.0), (10.0, 100.0), (100.0, 25.0)]


def test_content_stream(spark):
    op = "struct<op: string, args: array<double>>"
    ops = [("BT", []), ("Tm", [1.0, 0.0, 0.0, 1.0, 5.0, 50.0]), ("Tj", []), ("TL", [10.0]), ("'", []), ('"', [1.0, 2.0]), ("Td", [100.0, 0.0]), ("TJ", []), ("ET", []), ("Tj", [])]
    df = spark.createDataFrame([(1, 0, ops, [(0.0, 35.0, 10.0, 55.0)])], f"doc_id long, page_number int, ops array<{op}>, boxes array<struct<x0: double, y0: double, x1: double, y1: double>>")
    got = [x.op for x in drawing.edit_stream(df).first().ops]
    assert got == ["BT", "Tm", "TL", "T*", '"', "Td", "TJ", "ET", "Tj"]
    wide = df.withColumn("boxes", F.expr("transform(boxes, b -> named_struct('x0', b.x0, 'y0', 0D, 'x1', 200D, 'y1', b.y1))"))
    assert [x.op for x in drawing.edit_stream(wide).first().ops] == ["BT", "Tm", "TL", "T*", "Tw", "Tc", "T*", "Td", "ET", "Tj"]


def test_versions(spark):
    bad = spark.createDataFrame([(1, '{"schema_version": "1.0.0", "paragraphs": {}}')], "doc_id long, json string")
    for read in (documents.read_base, documents.read_translations):
        with pytest.raises(Exception, match="unsupported version"):
            read(bad).collect()
    core = spark.createDataFrame([(1, '{"pages": [{"page_number": 0, "text_objects": [{"id": "a", "text": "é", "bbox": {"x0": 1, "y0": 2, "x1": 3, "y1": 4}}], "layout_blocks": [{"id": "b", "type": "table"}, {"id": "c", "raw_category": "zzz"}]}]}')], "doc_id long, json string")
    parsed = sources.parse_core(core)
    assert [(r.id, r.text, r.x0) for r in sources.text_objects(parsed).collect()] == [("a", "é", 1.0)]
    assert [(r.block_id, r.raw_category, r.confidence) for r in sources.layout_blocks(parsed).collect()] == [("b", "table", 0.0), ("c", "unknown", 0.0)]
    with pytest.raises(Exception, match="unsupported version"):
        sources.parse_core(spark.createDataFrame([(1, '{"version": "9", "pages": []}')], "doc_id long, json string")).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.b.json").write_text('{"version": "1.0.0", "pages": []}')
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    assert [(r.doc_id, r.version) for r in sources.parse_core(sources.read_texts(spark, f"{tmp_path}/*.json")).collect()] == [("a.b", "1.0.0")]
    assert [bytes(r.content) for r in sources.read_binary(spark, str(tmp_path)).collect()] == [b"%PDF"]
    sources.write_files(spark.createDataFrame([(1, "x")], "doc_id long, markdown string"), "markdown", f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").first().content == "x"
    wanted = spark.createDataFrame([("NotoSans-Regular.ttc", True), ("NotoSans-Regular.ttc", False), ("Odd.ttf", True)], "font string, is_bold boolean")
    fonts = spark.createDataFrame([("NotoSans-Bold.ttc",)], "file string")
    assert {(r.font, r.is_bold): r.file for r in sources.variant(fonts, wanted).collect()} == {("NotoSans-Regular.ttc", True): "NotoSans-Bold.ttc", ("NotoSans-Regular.ttc", False): None, ("Odd.ttf", True): None}


def test_geometry_and_summary(spark):
    left = spark.createDataFrame([(1, 0, 100.0, 200.0)], "doc_id long, page_number int, w double, h double")
    r = geometry.side_by_side(left, left.withColumn("h", F.lit(100.0)), 5.0).first()
    assert (r.width, r.height, r.left_y, r.right_y, r.right_x) == (205.0, 200.0, 0.0, 50.0, 105.0)
    with pytest.raises(Exception, match="page counts"):
        geometry.side_by_side(left, left.limit(0), 5.0).collect()
    p = spark.createDataFrame([(1, 0, "text", "b", 1.0, 0), (2, 0, "doc_title", "T", 1.0, 0), (2, 0, "doc_title", "S", 9.0, 1)], "doc_id long, page_number int, category string, text string, y1 double, input_pos int")
    made = spark.createDataFrame([(1, "made", None, "org")], "doc_id long, title string, abstract string, organization string")
    got = {r.doc_id: (r.title, r.abstract, r.organization, r.title_source) for r in summary.layout_summary(p, generated=made).collect()}
    assert got == {1: ("made", None, "org", "llm"), 2: ("S\n\nT", None, None, "layout")}
    names = spark.createDataFrame([("MonoTimes", True, True), ("NimbusRomNo9L", True, False), ("Arial", False, True)], "n string, b boolean, i boolean")
    assert [r[0] for r in names.select(documents.fallback_font(F.col("n"), F.col("b"), F.col("i"))).collect()] == ["Courier-BoldOblique", "Times-Bold", "Helvetica-Oblique"]
    assert one(spark, documents.markdown_name, "a.b.pdf") == "a.b.md"


def test_diff(spark):
    schema = "doc_id long, id string, text string, x0 double, y0 double, x1 double, y1 double"
    old = spark.createDataFrame([(1, "a", "x  y", 0.0, 0.0, 1.0, 1.0), (1, "b", "q", 0.0, 0.0, 1.0, 1.0)], schema)
    new = spark.createDataFrame([(1, "a", "x y", 3.0, 0.0, 1.0, 1.0), (1, "c", "q", 0.0, 0.0, 1.0, 1.0)], schema)
    assert evaluate.diff(old, new).first().asDict() == {"doc_id": 1, "missing": 1, "extra": 1, "text_mismatch": 0, "position_error": 3.0}
    assert evaluate.rates(old, new, 2.0).first().asDict() == {"doc_id": 1, "match_rate": 0.5, "position_rate": 0.0, "preservation_rate": 1.0}


def test_landing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"doc_id": i, "text": f"t{i}"}))
    stream = landing.paragraphs_stream(spark, f"{tmp_path}/in", "doc_id long, text string", 1)
    landing.run(stream, lambda df: df.withColumn("n", F.length("text")), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert sorted((r.doc_id, r.n, r.batch) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(0, 2, 0), (1, 2, 1), (2, 2, 2)] or spark.read.parquet(f"{tmp_path}/out").count() == 3


class Model:
    def detect(self, image):
        return [{"label": "text", "score": 0.5, "coordinate": [0.0, 0.0, float(len(image)), 1.0]}]


def test_detection_and_translated_summary(spark):
    pages = spark.createDataFrame([(1, 0, b"abc")], "doc_id long, page_number int, image binary")
    assert [(r.label, r.coordinate[2]) for r in detect.analyse(pages, Model).first().boxes] == [("text", 3.0)]
    rows = spark.createDataFrame([(1, "T", None, "md"), (2, None, None, None)], "doc_id long, title string, abstract string, markdown string")
    got = [tuple(r) for r in summary.translated_summary(rows, translate.MockBackend(), "en", "ja", str.upper).collect()]
    assert got == [(1, "[translated]T", None, "MD")]
    assert [tuple(r) for r in summary.translated_summary(rows, Odd(fails=9), "en", "ja").collect()] == []


def test_command_line(spark, tmp_path):
    spark.createDataFrame([(1, "a\x02b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cli.main(["normalize_text", str(tmp_path), "--out", f"{tmp_path}/out"])
    assert spark.read.parquet(f"{tmp_path}/out").first().text == "a-b"


def test_draw_plan_of_several_pages(spark, tmp_path):
    """Every translated paragraph of every page, against fit_text line by line."""
    import __spark_entry__ as entry
    from quirework import catalog

    lines = [f"line {i} " + "word " * (i % 30) for i in range(40)]
    spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[:14]))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    font, want = fit.Font(), []
    for r in catalog.translated(spark, str(tmp_path)).where("translated_text <> ''").collect():
        size, _, _, made = fit.fit_text(r.translated_text, r.x1 - r.x0, r.y1 - r.y0, r.original_font_size, font)
        y, n = r.y1 - font.ascent * size, 0
        for line in made:
            if line != fit.BREAK:
                want.append((r.doc_id, r.page_number, r.id, n, line, size, r.x0, y))
                n += 1
            y -= font.line_height(size) * (0.5 if line == fit.BREAK else 1)
    got = [tuple(r) for r in entry.queries()["draw_plan"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert {(d, p) for d, p, *_ in got} == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)}


def test_versions_are_compared_whole(spark):
    schema = "doc_id long, id string, text string, x0 double, y0 double, x1 double, y1 double, original_font_size double"
    rows = [(1, i, i, 0.0, 0.0, 10.0, 10.0, 9.0) for i in "abcdef"]
    old = spark.createDataFrame([*rows, (2, "a", "a", 0.0, 0.0, 1.0, 1.0, 9.0)], schema)
    changed = [(1, "a", "a ", 0.0, 0.0, 12.0, 10.0, 9.5), (1, "b", "other", 0.0, 0.0, 10.0, 10.0, 9.0), (1, "c", "c", 0.0, 0.0, 17.0, 10.0, 9.0), (1, "d", "d", 0.0, 0.0, 10.0, 4.0, 9.0), (1, "e", "e", 0.0, 0.0, 10.0, 10.0, 10.0)]
    new = spark.createDataFrame([*changed, (2, "a", "all new", 0.0, 0.0, 1.0, 1.0, None), (3, "z", "z", 0.0, 0.0, 1.0, 1.0, 9.0)], schema)
    got = {r.doc_id: r for r in evaluate.diff(old, new).collect()}
    assert (got[1].position_error, got[1].font_size_error, got[1].text_mismatch, got[1].missing) == (7.0, 1.0, 1, 1)
    assert {r.doc_id: r.position_rate for r in evaluate.rates(old, new, 2.0).collect()} == {1: 0.5, 2: 1.0}
    full = {r.doc_id: tuple(r)[1:] for r in evaluate.agreement(old, new, 2.0, 0.5).collect()}
    assert full == {1: (6, 1, 0, 1, 2, 1, 7.0, 1.0, 1 / 6), 2: (1, 0, 0, 1, 0, 0, 0.0, None, 0.0), 3: (0, 0, 1, 0, 0, 0, None, None, 1.0)}


def test_charsets_have_the_margin(spark):
    p = spark.createDataFrame([(True, False, "ab1"), (False, False, "b"), (False, True, "")], "is_bold boolean, is_italic boolean, text string")
    got = {(r.is_bold, r.is_italic, r.ch) for r in summary.style_charsets(p).collect()}
    assert got == {(True, False, c) for c in "ab" + summary.MARGIN} | {(False, False, c) for c in "b" + summary.MARGIN}
    assert sorted(tuple(r) for r in summary.style_charsets(p, margin="").collect()) == [(False, False, "b"), (True, False, "1"), (True, False, "a"), (True, False, "b")]


def test_documents_of_the_formats_own_shape(spark):
    import json

    from quirework.operators import documents

    p = {"id": "para_p0_b0", "page_number": 0, "text": "A title", "block_bbox": {"x0": 117.25, "y0": 751.5, "x1": 478.0, "y1": 769.5}, "line_count": 1, "original_font_size": 14.3, "is_bold": True, "is_italic": False, "rotation": 0.0, "alignment": "center", "layout_block_id": "a3", "category": "doc_title", "category_confidence": 0.94, "font_name": "N-Medi"}
    doc = {"schema_version": "2.0.0", "metadata": {"source_file": "s.pdf", "source_lang": "en", "page_count": 1, "paragraph_count": 1}, "summary": {"title": "A title", "thumbnail_width": 400, "title_source": "layout"}, "paragraphs": [p]}
    docs = spark.createDataFrame([("s", json.dumps(doc))], "doc_id string, json string")
    (r,) = documents.read_base(docs).collect()
    assert (r.x0, r.y0, r.x1, r.y1) == (117.25, 751.5, 478.0, 769.5) and (r.source_file, r.alignment, r.layout_block_id, r.font_name) == ("s.pdf", "center", "a3", "N-Medi")
    (s,) = documents.read_summaries(docs).collect()
    assert (s.title, s.thumbnail_width, s.title_source, s.abstract) == ("A title", 400, "layout", None)
    back = documents.base_documents(documents.read_base(docs), "en", "source_file", documents.read_summaries(docs)).first().json
    assert json.loads(back) == doc
    tr = {"schema_version": "2.0.0", "target_lang": "ja", "base_file": "s.json", "translated_at": "t", "translator_backend": "google", "translated_count": 1, "summary": {"title": "T"}, "paragraphs": {"para_p0_b0": "T"}}
    trs = spark.createDataFrame([("s", json.dumps(tr))], "doc_id string, json string")
    (t,) = documents.read_translations(trs).collect()
    assert (t.base_file, t.translated_count, t.id, t.text) == ("s.json", 1, "para_p0_b0", "T") and documents.read_summaries(trs, True).first().title == "T"


def test_a_mismatch_of_one_text():
    from quirework.operators import translate

    class Odd:
        name, max_text_length = "odd", None

        def translate_batch(self, texts, source, target):
            return ["x"] * (len(texts) + 1)

    import pytest

    assert translate.translate_all(Odd(), ["one"], "en", "ja") == ["one"]
    assert translate.translate_all(Odd(), ["one", "two"], "en", "ja") == ["one", "two"]
    with pytest.raises(translate.LengthMismatch):
        translate.translate_all(Odd(), ["one"], "en", "ja", strict=True)


def test_replies_and_limits(spark):
    import json

    from quirework.operators import backends

    texts = ['{"a": 1}', 'So:\n```json\n{"a": 2}\n```\nthat', "```\n[1]\n```", "```json\n{\"a\": 3}", "none", "", None]
    got = [r.j for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i").select(backends.reply_json(F_col("x")).alias("j")).collect()]
    assert got == ['{"a":1}', '{"a":2}', "[1]", '{"a":3}', None, None, None]
    assert [backends.extract_json(x) for x in texts[:5]] == [{"a": 1}, {"a": 2}, [1], {"a": 3}, None]
    assert [backends.context_of(m) for m in ("gpt-4o-mini-2024", "gpt-5-chat-latest", "gpt-5.1-codex", "gpt-4", "gpt-4-turbo-preview", "other")] == [128_000, 128_000, 400_000, 8_000, 128_000, 8_000]
    assert (backends.language("JA"), backends.language("uk"), backends.language("auto"), backends.language("xx")) == ("Japanese", "Ukrainian", "the source language", "xx")
    assert backends.byte_chunks(["a" * 3, "b" * 3, "c"], 2, 5) == [["aaa"], ["bbb", "c"]]
    asked = []

    def send(url, body, headers):
        asked.append(json.loads(body))
        texts = json.loads(asked[-1]["messages"][0]["content"].split("\n", 1)[1])
        return 200, json.dumps({"choices": [{"message": {"content": json.dumps({"translations": [{"index": x["index"], "translation": x["text"].upper()} for x in texts]})}}]})

    chat = backends.ChatBackend("u", "k", "gpt-4", send=send)
    assert chat.max_text_length == 2000 and chat.translate_batch(["a" * 3000, "b" * 3000, "c"], "en", "ja") == ["A" * 3000, "B" * 3000, "C"]
    assert len(asked) == 2 and asked[0]["response_format"]["type"] == "json_schema"
    assert backends.translated_sentences('[[["Hallo ","Hello "],["Welt","world"]],null,"en"]') == "Hallo Welt" and backends.translated_sentences("plain") == "plain"
    import pytest

    from quirework.operators.translate import ConfigurationError

    assert backends.backend("mock").name == "mock" and backends.backend("openai", "k").model == "gpt-4o-mini" and "api-free" in backends.backend("deepl", "k:fx").url
    for name, key in (("deepl", ""), ("other", "k")):
        with pytest.raises(ConfigurationError):
            backends.backend(name, key)


def test_generated_summaries(spark):
    from quirework.operators import backends

    rows = [(1, "# T ![x](y.png) body", "page one"), (2, None, None), (3, "boom", "boom")]
    docs = spark.createDataFrame(rows, "doc_id long, markdown string, first_page string")
    got = {r.doc_id: tuple(r)[1:] for r in backends.generated(docs, _answer, "ja").collect()}
    assert got == {1: ("T", None, "Lab", "sum of # T  body in Japanese"), 2: (None,) * 4, 3: (None,) * 4}
    assert backends.generated(docs.limit(0), _answer).collect() == []


def _answer(question):
    head, text = question.split("\n\n", 1)
    if text == "boom":
        raise ValueError(text)
    return f"sum of {text} in Japanese" if "in Japanese" in head else '```json\n{"title": "T", "abstract": null, "organization": "Lab"}\n```'


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_no_documents(spark):
    from quirework.sources import documents as sources

    empty = sources.empty_core(spark)
    some = sources.parse_core(spark.createDataFrame([("a", '{"pages": []}')], "doc_id string, json string"))
    assert empty.columns == some.columns and empty.unionByName(some).count() == 1 and sources.text_objects(empty).count() == 0


def test_summary_sources(spark):
    """Layout is the source unless a model's text stands in; an empty text of a model does not."""
    p = spark.createDataFrame([(i, 0, "text", "b", 1.0, 0) for i in range(3)] + [(3, 0, "doc_title", "T", 1.0, 0)], "doc_id long, page_number int, category string, text string, y1 double, input_pos int")
    made = spark.createDataFrame([(0, "made", ""), (1, "", "a"), (3, "made", None)], "doc_id long, title string, abstract string").withColumn("organization", F.lit(None).cast("string"))
    got = {r.doc_id: (r.title, r.abstract, r.title_source, r.abstract_source) for r in summary.layout_summary(p, generated=made).collect()}
    assert got == {0: ("made", None, "llm", "layout"), 1: (None, "a", "layout", "llm"), 2: (None, None, "layout", "layout"), 3: ("T", None, "layout", "layout")}
    assert {r.title_source for r in summary.layout_summary(p).collect()} == {"layout"}


def test_refused_keys_are_errors(spark):
    class Refusing:
        name, max_text_length = "refusing", None

        def translate_batch(self, texts, source, target):
            raise translate.ConfigurationError("the key was refused")

    def used_up(prompt):
        raise translate.QuotaError("the quota is used up")

    rows = spark.createDataFrame([(1, "T", None, "md")], "doc_id long, title string, abstract string, markdown string")
    with pytest.raises(Exception, match="the key was refused"):
        summary.translated_summary(rows, Refusing(), "en", "ja").collect()
    with pytest.raises(Exception, match="the quota is used up"):
        backends.generated(rows.withColumn("first_page", F.lit("x")), used_up).collect()


def test_character_sets_of_documents(spark):
    rows = [(1, False, False, "ab\U0001f600"), (1, False, False, "日bé"), (1, True, False, "z"), (2, False, False, ""), (3, None, False, "\x7f\x80\xff")]
    p = spark.createDataFrame(rows, "doc_id long, is_bold boolean, is_italic boolean, text string")
    got = {(r.doc_id, r.is_bold): r.chars for r in summary.charsets(p, "").collect()}
    assert got == {(1, False): "abé日\U0001f600", (1, True): "z", (3, None): "\x7f\x80\xff"}
    plan = summary.charsets(p)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" in plan and "explode" not in plan  # blocks of code points, not characters
    whole = {(r.is_bold): r.chars for r in summary.charsets(p, "", ()).collect()}
    assert whole[False] == "abé日\U0001f600"


def test_tables_of_different_pages_stay_apart(spark):
    from quirework.operators import tables

    box = "doc_id long, page_number int, {} x0 double, y0 double, x1 double, y1 double"
    blocks = spark.createDataFrame([(1, n, "b", 0.0, 0.0, 100.0, 100.0) for n in (0, 1)], box.format("block_id string,"))
    objects = spark.createDataFrame([(1, n, n, f"t{n}", 5.0, 5.0, 9.0, 9.0) for n in (0, 1)], box.format("pos long, text string,"))
    assert sorted((r.table_id, r.text) for r in tables.objects_in_tables(objects, blocks).collect()) == [("1/0/b", "t0"), ("1/1/b", "t1")]
