"""Queries over the driver's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as t
from .operators import categories, chunking, documents, evaluate, extract, geometry, markdown, match, merge, splitting, summary, tables, translate, translation_cache
from .plans.views import duck, spark_view
from .sources import documents as sources
from .sources import files, scratch
from .sources import pages as page_source

QUERIES: dict = {}
ORACLE: dict = {}
IN_SET = "('text','vertical_text','abstract','aside_text','figure_title')"
SKIP = "('header','header_image','footer','footer_image','page_number','number','aside_text','footnote','vision_footnote','formula_number','seal')"


def query(sql: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = duck(sql, *views) if views else sql
        return f

    return add


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return spark_view(spark, d, "v_paragraphs")


def translated(spark: SparkSession, d: str) -> DataFrame:
    return documents.overlay(paragraphs(spark, d), spark_view(spark, d, "v_translations"))


# Markdown

_KIND = """CASE WHEN category IS NULL THEN 'p' WHEN category='doc_title' THEN 'h1' WHEN category='paragraph_title' THEN 'h2' WHEN category='aside_text' THEN 'blockquote'
 WHEN category='table' THEN 'table' WHEN category='display_formula' THEN 'code_block' ELSE 'p' END"""
_MARK = "CASE WHEN is_bold AND is_italic THEN '***' WHEN is_bold THEN '**' WHEN is_italic THEN '*' ELSE '' END"


def _fmt(x: str, code: bool = True) -> str:
    s = f"concat({_MARK}, {x}, {_MARK})"
    block = f"WHEN kind='code_block' THEN concat('```', chr(10), {s}, chr(10), '```')" if code else ""
    return f"concat(CASE kind WHEN 'h1' THEN '# ' WHEN 'h2' THEN '## ' ELSE '' END, CASE WHEN kind='table' THEN {x} {block} WHEN kind='blockquote' THEN concat('> ', replace({s}, chr(10), concat(chr(10), '> '))) ELSE {s} END, chr(10))"


def _markdown_sql(shown: str, extra: str = "''", source: str = "v_paragraphs p", tr: str = "CAST(NULL AS VARCHAR)", head: str = "''") -> str:
    return f"""SELECT doc_id, concat({head}, string_agg(concat_ws(chr(10), mark, md), chr(10) ORDER BY input_pos)) AS markdown FROM (
 SELECT doc_id, input_pos, CASE WHEN page_number <> before THEN concat(chr(10), '---', chr(10), '<!-- Page ', CAST(page_number+1 AS VARCHAR), ' -->', chr(10)) END AS mark,
  CASE WHEN coalesce(category IN {SKIP}, false) OR coalesce({shown},'')='' THEN NULL ELSE concat({_fmt(shown)}, {extra}) END AS md FROM (
 SELECT p.*, {tr} AS tr, {_KIND} AS kind, lag(page_number) OVER (PARTITION BY p.doc_id ORDER BY input_pos) AS before FROM {source}))
 WHERE mark IS NOT NULL OR md IS NOT NULL GROUP BY doc_id"""


_JOINED = "v_paragraphs p LEFT JOIN v_translations v ON p.doc_id=v.doc_id AND p.id=v.id"


@query(_markdown_sql("text"), "v_paragraphs")
def markdown_original(spark, d):
    return markdown.documents(paragraphs(spark, d), markdown.MarkdownConfig(mode="original"))


@query(_markdown_sql("coalesce(nullif(tr,''),text)", source=_JOINED, tr="v.translated_text", head="concat('---', chr(10), 'source_lang: en', chr(10), 'target_lang: ja', chr(10), 'translated_at: 2024-01-01T00:00:00', chr(10), '---', chr(10), chr(10))"), "v_paragraphs", "v_translations")
def markdown_translated(spark, d):
    config = markdown.MarkdownConfig(metadata={"source_lang": "en", "target_lang": "ja"}, translated_at="2024-01-01T00:00:00")
    return markdown.documents(translated(spark, d), config)


@query(_markdown_sql("text", extra=f"CASE WHEN coalesce(tr,'')='' OR kind='table' THEN '' ELSE {_fmt('tr', False)} END", source=_JOINED, tr="v.translated_text"), "v_paragraphs", "v_translations")
def markdown_parallel(spark, d):
    return markdown.documents(translated(spark, d), markdown.MarkdownConfig(mode="parallel"))


@query(
    f"""WITH k AS (SELECT *, concat('k', CAST(input_pos // 3 AS VARCHAR)) AS key FROM v_paragraphs),
 im AS (SELECT doc_id, key, concat('images/', CAST(max(input_pos) AS VARCHAR), '.png') AS path FROM k WHERE input_pos%2=0 GROUP BY 1,2),
 e AS (SELECT k.*, path FROM k JOIN im USING (doc_id, key) WHERE category='table' OR (category='display_formula' AND text<>''))
 SELECT doc_id, input_pos AS pos, concat('![', CASE WHEN category='table' THEN 'Table' ELSE 'Image' END, '](', path, ')', chr(10)) AS md FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY input_pos)=1""",
    "v_paragraphs",
)
def markdown_assets_once(spark, d):
    """Formulas count as images here, as the tables have no image paragraphs."""
    p = paragraphs(spark, d).withColumn("layout_block_id", F.expr("concat('k', CAST(input_pos div 3 AS STRING))"))
    p = p.withColumn("category", F.when(F.col("category") == "display_formula", "image").otherwise(F.col("category")))
    images = p.where("input_pos % 2 = 0").withColumn("relative_path", F.format_string("images/%d.png", "input_pos"))
    out = markdown.blocks(p, markdown.MarkdownConfig(mode="original", page_breaks=False), images)
    return out.where("md LIKE '![Table](%' OR md LIKE '![Image](%'").select("doc_id", "pos", "md")


# Matching

_IX = "(least(p.x1,b.x1)-greatest(p.x0,b.x0))"
_IY = "(least(p.y1,b.y1)-greatest(p.y0,b.y0))"
_PAIRS = f"""SELECT p.doc_id, p.id, b.block_id, b.raw_category, b.confidence, b.block_pos, (b.x1-b.x0)*(b.y1-b.y0) AS area,
 {_IX}*{_IY}/((p.x1-p.x0)*(p.y1-p.y0)) AS containment FROM v_paragraphs p JOIN v_blocks b ON p.doc_id=b.doc_id AND p.page_number=b.page_number AND {_IX}>0 AND {_IY}>0
 WHERE {_IX}*{_IY}/((p.x1-p.x0)*(p.y1-p.y0)) >= 0.5"""
_PRIO = "CASE raw_category WHEN 'inline_formula' THEN 1 WHEN 'table' THEN 3 ELSE 6 END"


@query(f"SELECT doc_id, id, block_id, containment FROM ({_PAIRS})", "v_blocks")
def containment_pairs(spark, d):
    return match.containment_pairs(paragraphs(spark, d), spark_view(spark, d, "v_blocks")).select("p.doc_id", "p.id", "b.block_id", "containment")


@query(
    f"""SELECT p.doc_id, p.id, m.raw_category AS category, m.confidence AS category_confidence, m.block_id AS layout_block_id FROM v_paragraphs p LEFT JOIN
 (SELECT * FROM ({_PAIRS}) QUALIFY row_number() OVER (PARTITION BY doc_id, id ORDER BY {_PRIO}, containment DESC, block_pos)=1) m ON p.doc_id=m.doc_id AND p.id=m.id""",
    "v_blocks",
)
def assign_categories(spark, d):
    return match.assign_categories(paragraphs(spark, d), spark_view(spark, d, "v_blocks")).select("doc_id", "id", "category", "category_confidence", "layout_block_id")


_MATCHED = f"""SELECT p.doc_id, p.id, coalesce(m.raw_category, 'unknown') AS category FROM v_paragraphs p LEFT JOIN
 (SELECT * FROM ({_PAIRS}) QUALIFY row_number() OVER (PARTITION BY doc_id, id ORDER BY {_PRIO}, containment DESC, area, block_pos)=1) m ON p.doc_id=m.doc_id AND p.id=m.id"""


@query(_MATCHED, "v_blocks")
def match_text_objects(spark, d):
    return match.match_text_objects(paragraphs(spark, d), spark_view(spark, d, "v_blocks"))


@query(f"SELECT * FROM ({_MATCHED}) WHERE category IN {IN_SET}", "v_blocks")
def translatable_objects(spark, d):
    return match.translatable_objects(match_text_objects(spark, d))


@query(f"SELECT doc_id, id, category FROM v_paragraphs WHERE category IS NULL OR category IN {IN_SET}", "v_paragraphs")
def translatable_paragraphs(spark, d):
    return paragraphs(spark, d).where(categories.translatable(F.col("category"))).select("doc_id", "id", "category")


@query("SELECT p.doc_id, p.id FROM v_paragraphs p WHERE NOT EXISTS (SELECT 1 FROM v_blocks b WHERE b.raw_category<>'text' AND p.doc_id=b.doc_id AND p.page_number=b.page_number AND p.x0+1 BETWEEN b.x0-0.5 AND b.x1+0.5 AND p.y1-50 BETWEEN b.y0-0.5 AND b.y1+0.5)", "v_blocks")
def remove_covered_text(spark, d):
    points = paragraphs(spark, d).select("doc_id", "page_number", "id", (F.col("x0") + 1).alias("x"), (F.col("y1") - 50).alias("y"))
    return match.uncovered(points, spark_view(spark, d, "v_blocks").where("raw_category <> 'text'")).select("doc_id", "id")


# Geometry

@query("""SELECT s_suppkey AS id, 'd' || CAST(s_suppkey % 7 AS VARCHAR) AS label, CAST(s_suppkey AS DOUBLE)/2 AS x0, CAST(1000-s_suppkey-30 AS DOUBLE)/2 AS y0, CAST(s_suppkey+40 AS DOUBLE)/2 AS x1, CAST(1000-s_suppkey AS DOUBLE)/2 AS y1 FROM supplier WHERE s_suppkey % 5 <> 0""")
def image_to_pdf_coords(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    c = [F.col("s_suppkey").cast("double") + x for x in (0, 0, 40, 30)]
    box = F.struct(F.format_string("d%d", F.col("s_suppkey") % 7).alias("label"), F.lit(0.5).alias("score"), F.when(F.col("s_suppkey") % 5 == 0, F.array(*c[:3])).otherwise(F.array(*c)).alias("coordinate"))
    rows = s.select(F.col("s_suppkey").alias("doc_id"), F.lit(0).alias("page_number"), F.array(box).alias("boxes"))
    return extract.detections(rows, [f"d{i}" for i in range(7)], 2.0, 1000.0).select(F.col("doc_id").alias("id"), F.col("raw_category").alias("label"), "x0", "y0", "x1", "y1")


@query(f"""SELECT p.doc_id, p.id, b.id AS other, CASE WHEN {_IX} > 0 THEN {_IX}/least(p.x1-p.x0, b.x1-b.x0) ELSE 0 END AS overlap
 FROM v_paragraphs p JOIN v_paragraphs b ON p.doc_id=b.doc_id AND p.page_number=b.page_number AND b.input_pos=p.input_pos+1""", "v_paragraphs")
def x_overlap(spark, d):
    p = paragraphs(spark, d)
    return geometry.neighbour_overlap(p)


@query("SELECT doc_id, page_number, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS boxes, sum((x1-x0)*(y1-y0)) AS area FROM v_paragraphs GROUP BY 1,2", "v_paragraphs")
def page_extents(spark, d):
    return geometry.page_extents(paragraphs(spark, d))


@query("""WITH e AS (SELECT doc_id, page_number, max(x1) AS w, max(y1) AS h FROM v_paragraphs GROUP BY 1,2), f AS (SELECT doc_id, page_number, w+10 AS w, h-page_number AS h FROM e)
 SELECT e.doc_id, e.page_number, e.w+10+f.w AS width, greatest(e.h,f.h) AS height, (greatest(e.h,f.h)-e.h)/2 AS left_y, (greatest(e.h,f.h)-f.h)/2 AS right_y, e.w+10 AS right_x FROM e JOIN f USING (doc_id, page_number)""", "v_paragraphs")
def side_by_side_geometry(spark, d):
    left = paragraphs(spark, d).groupBy("doc_id", "page_number").agg(F.max("x1").alias("w"), F.max("y1").alias("h"))
    right = left.select("doc_id", "page_number", (F.col("w") + 10).alias("w"), (F.col("h") - F.col("page_number")).alias("h"))
    return geometry.side_by_side(left, right, 10.0)


# Columns and merging

_OV = "(least(a.x1,{x}1)-greatest(a.x0,{x}0))"
_COLS = """WITH RECURSIVE pg AS (SELECT *, 0.5*max(x1) OVER (PARTITION BY doc_id, page_number) AS lim FROM v_paragraphs),
 nw AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY (x0+x1)/2, input_pos) AS rn FROM pg WHERE x1-x0 <= lim),
 wd AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY input_pos) AS rn FROM pg WHERE x1-x0 > lim),
 nf AS (SELECT doc_id, page_number, rn, input_pos, 0 AS col, [{'a': x0, 'b': x1}] AS mem FROM nw WHERE rn=1
  UNION ALL SELECT n.doc_id, n.page_number, n.rn, n.input_pos, CASE WHEN j THEN col ELSE col+1 END, CASE WHEN j THEN list_append(mem, {'a': x0, 'b': x1}) ELSE [{'a': x0, 'b': x1}] END
  FROM (SELECT n.*, f.col, f.mem, list_max(list_transform(f.mem, lambda m: CASE WHEN least(m.b,n.x1)-greatest(m.a,n.x0)>0 THEN (least(m.b,n.x1)-greatest(m.a,n.x0))/least(m.b-m.a,n.x1-n.x0) ELSE 0 END)) >= 0.5 AS j
   FROM nf f JOIN nw n ON n.doc_id=f.doc_id AND n.page_number=f.page_number AND n.rn=f.rn+1) n),
 ex AS (SELECT doc_id, page_number, list({'a': lo, 'b': hi} ORDER BY col) AS ext FROM (SELECT nf.doc_id, nf.page_number, col, min(x0) AS lo, max(x1) AS hi FROM nf JOIN nw USING (doc_id, page_number, rn) GROUP BY 1,2,3) GROUP BY 1,2),
 wf AS (SELECT doc_id, page_number, CAST(0 AS BIGINT) AS rn, -1 AS input_pos, -1 AS col, ext FROM ex
  UNION ALL SELECT doc_id, page_number, rn, input_pos, pick-1, list_transform(ext, lambda x, i: CASE WHEN i=pick THEN {'a': least(x.a,x0), 'b': greatest(x.b,x1)} ELSE x END)
  FROM (SELECT *, CASE WHEN list_max(ov)>0 THEN list_position(ov, list_max(ov)) ELSE 1 END AS pick FROM
   (SELECT w.doc_id, w.page_number, w.rn, w.input_pos, w.x0, w.x1, f.ext, list_transform(f.ext, lambda x: greatest(least(x.b,w.x1)-greatest(x.a,w.x0),0)) AS ov
    FROM wf f JOIN wd w ON w.doc_id=f.doc_id AND w.page_number=f.page_number AND w.rn=f.rn+1))),
 cl AS (SELECT doc_id, page_number, input_pos, CAST(col AS INTEGER) AS col, rn-1 AS o FROM nf UNION ALL SELECT doc_id, page_number, input_pos, CAST(col AS INTEGER), 100000+rn FROM wf WHERE rn>0
  UNION ALL SELECT w.doc_id, w.page_number, w.input_pos, 0, w.rn FROM wd w WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.doc_id=w.doc_id AND nw.page_number=w.page_number))"""


@query(_COLS + " SELECT doc_id, page_number, input_pos, col FROM cl", "v_paragraphs")
def detect_columns(spark, d):
    return merge.detect_columns(paragraphs(spark, d)).select("doc_id", "page_number", "input_pos", "col")


_D4 = f"""coalesce(f.category=n.category AND f.category IN {IN_SET}, false) AND f.y0-n.y1>=0 AND f.y0-n.y1<=f.fs*0.5
 AND CASE WHEN least(f.x1,n.x1)-greatest(f.x0,n.x0)>0 THEN (least(f.x1,n.x1)-greatest(f.x0,n.x0))/least(f.x1-f.x0,n.x1-n.x0) ELSE 0 END>=0.7 AND abs(f.fs-n.fs)<=1 AND least(f.x1-f.x0,n.x1-n.x0)/greatest(f.x1-f.x0,n.x1-n.x0)>=0.95"""
_MERGE = (
    _COLS
    + f""", it AS (SELECT p.doc_id, p.page_number, col, id, text, x0, y0, x1, y1, line_count AS lc, original_font_size AS fs, category, category_confidence AS conf,
  row_number() OVER (PARTITION BY p.doc_id, p.page_number, col ORDER BY -y1, o) AS rn FROM v_paragraphs p JOIN cl ON p.doc_id=cl.doc_id AND p.page_number=cl.page_number AND p.input_pos=cl.input_pos),
 mf AS (SELECT doc_id, page_number, col, rn, rn AS grp, id, text, x0, y0, x1, y1, lc, fs, category, conf FROM it WHERE rn=1
  UNION ALL SELECT n.doc_id, n.page_number, n.col, n.rn, CASE WHEN m THEN g ELSE n.rn END, CASE WHEN m THEN fid ELSE n.id END, CASE WHEN m THEN concat(ft, chr(10), n.text) ELSE n.text END,
   CASE WHEN m THEN least(fx0,n.x0) ELSE n.x0 END, CASE WHEN m THEN least(fy0,n.y0) ELSE n.y0 END, CASE WHEN m THEN greatest(fx1,n.x1) ELSE n.x1 END, CASE WHEN m THEN greatest(fy1,n.y1) ELSE n.y1 END,
   CASE WHEN m THEN flc+n.lc ELSE n.lc END, CASE WHEN m THEN ffs ELSE n.fs END, n.category, CASE WHEN m THEN least(fconf,n.conf) ELSE n.conf END
  FROM (SELECT n.*, f.grp AS g, f.id AS fid, f.text AS ft, f.x0 AS fx0, f.y0 AS fy0, f.x1 AS fx1, f.y1 AS fy1, f.lc AS flc, f.fs AS ffs, f.conf AS fconf, {_D4} AS m
   FROM mf f JOIN it n ON n.doc_id=f.doc_id AND n.page_number=f.page_number AND n.col=f.col AND n.rn=f.rn+1) n),
 mg AS (SELECT * FROM mf QUALIFY row_number() OVER (PARTITION BY doc_id, page_number, col, grp ORDER BY rn DESC)=1)"""
)


@query(_MERGE + " SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY -y1, col, rn)-1 AS out_pos, id, text, x0, y0, x1, y1, lc AS line_count, category, conf AS category_confidence FROM mg", "v_paragraphs")
def merge_paragraphs(spark, d):
    return merge.merge_paragraphs(paragraphs(spark, d)).select("doc_id", "page_number", "out_pos", "id", "text", "x0", "y0", "x1", "y1", "line_count", "category", "category_confidence")


@query(_MERGE + " SELECT mg.doc_id, mg.id, length(mg.text) AS after_chars, length(p.text) AS before_chars FROM mg LEFT JOIN v_paragraphs p ON mg.doc_id=p.doc_id AND mg.id=p.id WHERE length(mg.text) > coalesce(length(p.text),0)*CAST(1.1 AS DOUBLE)", "v_paragraphs")
def merge_growth(spark, d):
    p = paragraphs(spark, d)
    return merge.merge_growth(merge.merge_paragraphs(p), p).select("doc_id", "id", F.length("text").alias("after_chars"), F.col("before").alias("before_chars"))


@query(_MERGE + f""" , o AS (SELECT doc_id, count(*) AS original FROM v_paragraphs GROUP BY 1), m AS (SELECT doc_id, count(*) AS final, count(*) FILTER (WHERE category IS NULL OR category IN {IN_SET}) AS translated FROM mg GROUP BY 1)
 SELECT doc_id, original, final, original-final AS merged, translated, final-translated AS skipped FROM o JOIN m USING (doc_id)""", "v_paragraphs")
def run_stats(spark, d):
    p = paragraphs(spark, d)
    return documents.run_stats(p, merge.merge_paragraphs(p))


# Documents

@query("SELECT p.doc_id, p.id, p.text, v.translated_text FROM " + _JOINED, "v_paragraphs", "v_translations")
def overlay_translations(spark, d):
    return translated(spark, d).select("doc_id", "id", "text", "translated_text")


@query("SELECT doc_id, '2.0.0' AS schema_version, count(*) AS paragraph_count, max(page_number)+1 AS page_count, string_agg(id, ',' ORDER BY input_pos) AS ids, string_agg(text, chr(10) ORDER BY input_pos) AS texts FROM v_paragraphs GROUP BY 1", "v_paragraphs")
def base_document_json(spark, d):
    made = documents.base_documents(paragraphs(spark, d), "en")
    return documents.read_base(made).groupBy("doc_id", "schema_version", "paragraph_count", "page_count").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("input_pos", "id"))), lambda x: x["id"]), ",").alias("ids"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("input_pos", "text"))), lambda x: x["text"]), "\n").alias("texts"),
    )


@query("SELECT doc_id, id, translated_text AS text, count(*) OVER (PARTITION BY doc_id) AS translated_count FROM v_translations WHERE translated_text<>''", "v_translations")
def translation_json(spark, d):
    made = documents.translation_documents(translated(spark, d), "ja", "mock", "2024-01-01T00:00:00")
    return documents.read_translations(made).select("doc_id", "id", "text", F.col("translated_count").cast("long").alias("translated_count"))


_STYLED = "CAST(input_pos%4*90 AS DOUBLE) AS rotation, CASE input_pos%3 WHEN 0 THEN 'left' WHEN 1 THEN 'center' ELSE 'right' END AS alignment, concat('font', CAST(input_pos%5 AS {str})) AS font_name, concat('blk', CAST(input_pos AS {str})) AS layout_block_id"


def styled(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs with made-up styles."""
    return paragraphs(spark, d).selectExpr("*", *_STYLED.format(str="STRING").replace(" AS rotation, ", " AS rotation;").replace(" AS alignment, ", " AS alignment;").replace(" AS font_name, ", " AS font_name;").split(";"), "named_struct('r', CAST(input_pos%7 AS INT), 'g', 1, 'b', 2) AS text_color")


@query(_MERGE + f" SELECT mg.doc_id, mg.id, s.rotation, s.alignment, s.font_name, s.layout_block_id, CAST(s.input_pos%7 AS INTEGER) AS red FROM mg JOIN (SELECT doc_id, id, input_pos, {_STYLED.format(str='VARCHAR')} FROM v_paragraphs) s ON mg.doc_id=s.doc_id AND mg.id=s.id", "v_paragraphs")
def merge_styles(spark, d):
    return merge.merge_paragraphs(styled(spark, d)).select("doc_id", "id", "rotation", "alignment", "font_name", "layout_block_id", F.col("text_color.r").alias("red"))


@query(f"SELECT doc_id, input_pos, id, page_number, x0, y0, x1, y1, line_count, original_font_size, category, category_confidence, is_bold, is_italic, CAST(input_pos%7 AS INTEGER) AS red, concat('d', CAST(doc_id AS VARCHAR), '.pdf') AS source_file, {_STYLED.format(str='VARCHAR')} FROM v_paragraphs WHERE true", "v_paragraphs")
def base_document_fields(spark, d):
    p = styled(spark, d).withColumn("source_file", F.format_string("d%d.pdf", "doc_id"))
    # input_pos counts a document's paragraphs without gaps only after writing
    n = p.select("doc_id", "id", F.col("input_pos").alias("at"))
    back = documents.read_base(documents.base_documents(p, "en", "source_file")).drop("input_pos").join(n, ["doc_id", "id"])
    return back.select("doc_id", F.col("at").alias("input_pos"), "id", "page_number", "x0", "y0", "x1", "y1", "line_count", "original_font_size", "category", "category_confidence", "is_bold", "is_italic", F.col("text_color.r").alias("red"), "source_file", "rotation", "alignment", "font_name", "layout_block_id")


@query("SELECT doc_id, concat('d', CAST(doc_id AS VARCHAR), '.json') AS base_file, 'ja' AS target_lang, count(*) AS translated_count, string_agg(id, ',' ORDER BY id) AS ids, concat('[translated]', any_value(t)) AS title FROM v_translations JOIN (SELECT doc_id, string_agg(text, chr(10)||chr(10) ORDER BY page_number, -y1, input_pos) FILTER (WHERE category='doc_title' AND text<>'') AS t FROM v_paragraphs GROUP BY 1) USING (doc_id) WHERE translated_text<>'' GROUP BY 1", "v_paragraphs", "v_translations")
def translation_document_fields(spark, d):
    p = translated(spark, d).withColumn("base_file", F.format_string("d%d.json", "doc_id"))
    titles = summary.layout_summary(paragraphs(spark, d), "doc_title", "paragraph_title").select("doc_id", F.concat(F.lit("[translated]"), "title").alias("title"))
    made = documents.translation_documents(p, "ja", "mock", "2024-01-01T00:00:00", "base_file", titles)
    rows = documents.read_translations(made).groupBy("doc_id", "base_file", "target_lang").agg(F.count(F.lit(1)).alias("translated_count"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    return rows.join(documents.read_summaries(made, True).select("doc_id", "title"), "doc_id", "left")


@query(f"""SELECT doc_id, string_agg(text, chr(10)||chr(10) ORDER BY page_number, -y1, input_pos) FILTER (WHERE category='doc_title' AND text<>'') AS title,
 string_agg(text, chr(10)||chr(10) ORDER BY page_number, -y1, input_pos) FILTER (WHERE category='paragraph_title' AND text<>'') AS abstract,
 'layout' AS title_source FROM v_paragraphs GROUP BY 1""", "v_paragraphs")
def summary_title_abstract(spark, d):
    return summary.layout_summary(paragraphs(spark, d), "doc_title", "paragraph_title").select("doc_id", "title", "abstract", "title_source")


@query("""WITH g AS (SELECT doc_id, CASE doc_id%3 WHEN 0 THEN '' WHEN 1 THEN concat('t', CAST(doc_id AS VARCHAR)) END AS gt, CASE doc_id%2 WHEN 0 THEN 'an abstract' ELSE '' END AS ga FROM documents),
 f AS (SELECT doc_id, string_agg(text, chr(10)||chr(10) ORDER BY page_number, -y1, input_pos) FILTER (WHERE category='aside_text' AND text<>'') AS t, string_agg(text, chr(10)||chr(10) ORDER BY page_number, -y1, input_pos) FILTER (WHERE category='footnote' AND text<>'') AS a FROM v_paragraphs GROUP BY 1)
 SELECT doc_id, coalesce(t, nullif(gt, '')) AS title, coalesce(a, nullif(ga, '')) AS abstract, concat('o', CAST(doc_id AS VARCHAR)) AS organization,
 CASE WHEN t IS NULL AND gt<>'' THEN 'llm' ELSE 'layout' END AS title_source, CASE WHEN a IS NULL AND ga<>'' THEN 'llm' ELSE 'layout' END AS abstract_source FROM f JOIN g USING (doc_id)""", "v_paragraphs")
def summary_sources(spark, d):
    """Titles and abstracts of categories that many documents lack, with a model's texts for some of these, empty ones too."""
    made = spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", "CASE doc_id%3 WHEN 0 THEN '' WHEN 1 THEN concat('t', doc_id) END AS title", "CASE doc_id%2 WHEN 0 THEN 'an abstract' ELSE '' END AS abstract", "concat('o', doc_id) AS organization")
    return summary.layout_summary(paragraphs(spark, d), "aside_text", "footnote", made)


@query("SELECT doc_id, string_agg(text, chr(10)||chr(10) ORDER BY -y1, input_pos) FILTER (WHERE text<>'') AS text FROM v_paragraphs WHERE page_number=0 GROUP BY 1", "v_paragraphs")
def first_page_text(spark, d):
    return summary.first_page_text(paragraphs(spark, d))


@query("SELECT DISTINCT is_bold, is_italic, unnest(string_split(text, '')) AS ch FROM v_paragraphs", "v_paragraphs")
def style_charsets(spark, d):
    return summary.style_charsets(paragraphs(spark, d), margin="")


@query(f"SELECT DISTINCT is_bold, is_italic, unnest(list_concat(string_split(text, ''), string_split('{summary.MARGIN}', ''))) AS ch FROM v_paragraphs", "v_paragraphs")
def subset_charsets(spark, d):
    return summary.style_charsets(paragraphs(spark, d))


_DOCUMENT_CHARS = f"SELECT doc_id, is_bold, is_italic, string_agg(ch, '' ORDER BY ch) AS chars FROM (SELECT DISTINCT doc_id, is_bold, is_italic, unnest(list_concat(string_split(text, ''), string_split('{summary.MARGIN}', ''))) AS ch FROM v_paragraphs WHERE text<>'') GROUP BY 1,2,3"


@query(_DOCUMENT_CHARS, "v_paragraphs")
def document_charsets(spark, d):
    return summary.charsets(paragraphs(spark, d))


@query(f"SELECT doc_id, is_bold, is_italic, substr(sha256(concat('font:0:', chars)), 1, 16) AS cache_key FROM ({_DOCUMENT_CHARS})", "v_paragraphs")
def document_subset_keys(spark, d):
    return summary.subset_keys(summary.charsets(paragraphs(spark, d)), "font")


@query("SELECT coalesce(category,'none') AS category, count(*) FILTER (WHERE doc_id%2=0) AS model_a, count(*) FILTER (WHERE doc_id%2=1) AS model_b FROM v_paragraphs GROUP BY 1", "v_paragraphs")
def category_comparison(spark, d):
    return evaluate.category_counts(paragraphs(spark, d).withColumn("model", F.when(F.col("doc_id") % 2 == 0, "model_a").otherwise("model_b")), ["model_a", "model_b"])


_NEW = "(SELECT doc_id, CASE WHEN input_pos%11=3 THEN concat(id,'x') ELSE id END AS id, CASE WHEN input_pos%7=2 THEN concat(text,'!') ELSE concat(text, ' ') END AS text, x0+input_pos%5 AS x0, y0, x1+input_pos%5 AS x1, y1 FROM v_paragraphs WHERE input_pos%13<>4)"


def _changed(p: DataFrame, *more: str) -> DataFrame:
    return p.where("input_pos % 13 <> 4").selectExpr("doc_id", "CASE WHEN input_pos%11=3 THEN concat(id,'x') ELSE id END AS id", "CASE WHEN input_pos%7=2 THEN concat(text,'!') ELSE concat(text,' ') END AS text", "x0+input_pos%5 AS x0", "y0", "x1+input_pos%5 AS x1", "y1", *more)


@query(f"""SELECT coalesce(o.doc_id,n.doc_id) AS doc_id, count(*) FILTER (WHERE n.id IS NULL) AS missing, count(*) FILTER (WHERE o.id IS NULL) AS extra, count(*) FILTER (WHERE o.id IS NOT NULL AND n.id IS NOT NULL AND trim(o.text)<>trim(n.text)) AS text_mismatch,
 max(greatest(abs(o.x0-n.x0),abs(o.y0-n.y0))) AS position_error FROM v_paragraphs o FULL JOIN {_NEW} n ON o.doc_id=n.doc_id AND o.id=n.id GROUP BY 1""", "v_paragraphs")
def document_diff(spark, d):
    p = paragraphs(spark, d)
    return evaluate.diff(p, _changed(p))


@query(f"""WITH n AS (SELECT * FROM {_NEW}) SELECT doc_id, CAST(count(n.id) AS DOUBLE)/count(*) AS match_rate, CAST(count(*) FILTER (WHERE abs(o.x0-n.x0)<=2) AS DOUBLE)/count(*) AS position_rate,
 CAST((SELECT count(DISTINCT trim(a.text)) FROM v_paragraphs a WHERE a.doc_id=o.doc_id AND trim(a.text) IN (SELECT trim(text) FROM n WHERE n.doc_id=o.doc_id)) AS DOUBLE)/count(DISTINCT trim(o.text)) AS preservation_rate
 FROM v_paragraphs o LEFT JOIN n USING (doc_id, id) GROUP BY 1""".replace("count(n.id)", "count(n.y0)"), "v_paragraphs")
def evaluation_rates(spark, d):
    p = paragraphs(spark, d)
    return evaluate.rates(p, _changed(p), 2.0)


_RESIZED = "(SELECT doc_id, CASE WHEN input_pos%11=3 THEN concat(id,'x') ELSE id END AS id, CASE WHEN input_pos%7=2 THEN concat(text,'!') ELSE concat(text, ' ') END AS text, x0+input_pos%5 AS x0, y0, x1+input_pos%5+(CASE WHEN input_pos%6=1 THEN 7 ELSE 0 END) AS x1, y1-input_pos%4 AS y1, original_font_size+(input_pos%3)*0.25e0 AS original_font_size FROM v_paragraphs WHERE input_pos%13<>4)"


@query(f"""SELECT doc_id, count(*) FILTER (WHERE o) AS objects, count(*) FILTER (WHERE n IS NULL) AS missing, count(*) FILTER (WHERE o IS NULL) AS extra, count(*) FILTER (WHERE differs) AS text_mismatch, count(*) FILTER (WHERE shift>4) AS position_errors,
 count(*) FILTER (WHERE size>0.25e0) AS font_size_errors, max(shift) AS position_error, max(size) AS font_size_error, CASE WHEN count(*) FILTER (WHERE o)=0 THEN 1e0 ELSE CAST(count(*) FILTER (WHERE NOT differs AND shift<=4 AND size<=0.25e0) AS DOUBLE)/count(*) FILTER (WHERE o) END AS match_rate
 FROM (SELECT coalesce(a.doc_id,b.doc_id) AS doc_id, a.id IS NOT NULL OR NULL AS o, b.id IS NOT NULL OR NULL AS n, trim(a.text)<>trim(b.text) AS differs, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN greatest(abs(a.x0-b.x0),abs(a.y0-b.y0),abs(a.x1-b.x1),abs(a.y1-b.y1)) END AS shift,
 abs(a.original_font_size-b.original_font_size) AS size FROM v_paragraphs a FULL JOIN {_RESIZED} b ON a.doc_id=b.doc_id AND a.id=b.id) GROUP BY 1""", "v_paragraphs")
def document_agreement(spark, d):
    p = paragraphs(spark, d)
    new = _changed(p.withColumns({"x1": F.expr("x1 + CASE WHEN input_pos % 6 = 1 THEN 7 ELSE 0 END"), "y1": F.expr("y1 - input_pos % 4"), "size": F.expr("original_font_size + (input_pos % 3) * 0.25D")}), "size AS original_font_size")
    return evaluate.agreement(p, new, 4.0, 0.25)


@query("SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY input_pos) AS n, concat('table_', lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY input_pos) AS VARCHAR), 3, '0')) AS name FROM v_paragraphs WHERE category='table'", "v_paragraphs")
def file_numbering(spark, d):
    return documents.numbered(paragraphs(spark, d).where("category = 'table'"), "table").select("doc_id", "id", F.col("n").cast("long").alias("n"), "name")


# Text

@query("""SELECT doc_id, translate(replace(replace(text, chr(9), ' '), chr(10), ' '), concat(chr(2), chr(173), chr(11), chr(12), chr(13), chr(127), chr(255)), '--') AS text FROM documents""")
def normalize_text(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", t.normalise_controls(F.col("text")).alias("text"))


_ASCII = """replace(replace(replace(replace(translate(translate(replace(text, chr(9), ' '), concat(chr(2), chr(173), chr(11), chr(12), chr(13), chr(127), chr(255)), '--'), '×÷–‘’“”•°·', concat('x/-', chr(39), chr(39), '""*o.')), '—', '--'), '…', '...'), '±', '+/-'), 'μ', 'mu')"""


@query("""SELECT doc_id, replace(replace(replace(replace(translate(text, '×÷–‘’“”•°·', concat('x/-', chr(39), chr(39), '""*o.')), '—', '--'), '…', '...'), '±', '+/-'), 'μ', 'mu') AS text FROM documents""")
def ascii_fallback(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", t.ascii_fallback(F.col("text")).alias("text"))


_SPLIT = """WITH RECURSIVE r AS (SELECT doc_id, -1 AS part_no, '' AS part, text AS rest FROM documents WHERE length(text)>0
 UNION ALL SELECT doc_id, part_no+1, substr(rest,1,cut), substr(rest,cut+1) FROM (SELECT doc_id, part_no, rest,
  CASE WHEN length(rest)<=500 THEN length(rest) WHEN regexp_matches(substr(rest,1,500), '[.!?。！？]') THEN length(regexp_extract(substr(rest,1,500), '^((?s:.)*[.!?。！？][\\t\\n\\x0B\\f\\r ]*)', 1))
   WHEN instr(reverse(substr(rest,1,500)),' ')>0 AND 500-instr(reverse(substr(rest,1,500)),' ')>250 THEN 501-instr(reverse(substr(rest,1,500)),' ') ELSE 500 END AS cut FROM r WHERE length(rest)>0))"""


@query(_SPLIT + " SELECT doc_id, part_no, part FROM r WHERE part_no>=0")
def split_long_text(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").where("length(text) > 0")
    return splitting.split_texts(docs, "doc_id", 500).select("doc_id", "part_no", "part")


@query(_SPLIT + " SELECT doc_id, string_agg(part, ' ' ORDER BY part_no) AS text FROM r WHERE part_no>=0 GROUP BY 1")
def rejoin_parts(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").where("length(text) > 0")
    return splitting.rejoin(splitting.split_texts(docs, "doc_id", 500), "doc_id", "en")


@query("SELECT doc_id, id, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY input_pos)-1)//20 AS INTEGER) AS chunk FROM v_paragraphs", "v_paragraphs")
def chunk_fixed(spark, d):
    return chunking.by_number(paragraphs(spark, d), ["doc_id"], "input_pos", 20).select("doc_id", "id", "chunk")


def _chunk_sql(weight: str, most: int, count: int) -> str:
    over = f"f.n>={count} OR f.w+i.w>{most}"
    return f"""WITH RECURSIVE i AS (SELECT doc_id, input_pos, CAST({weight} AS BIGINT) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY input_pos) AS rn FROM v_paragraphs),
 f AS (SELECT doc_id, input_pos, rn, w, 1 AS n, 0 AS chunk FROM i WHERE rn=1 UNION ALL SELECT i.doc_id, i.input_pos, i.rn, CASE WHEN {over} THEN i.w ELSE f.w+i.w END, CASE WHEN {over} THEN 1 ELSE f.n+1 END, CASE WHEN {over} THEN f.chunk+1 ELSE f.chunk END
 FROM f JOIN i ON i.doc_id=f.doc_id AND i.rn=f.rn+1) SELECT doc_id, input_pos, chunk FROM f"""


@query(_chunk_sql("length(text)", 1500, 20), "v_paragraphs")
def chunk_tokens(spark, d):
    return chunking.by_weight(paragraphs(spark, d).withColumn("tokens", t.token_count(F.col("text"))), ["doc_id"], "input_pos", "tokens", 1500, 20)


@query(_chunk_sql("strlen(text)", 4096, 50), "v_paragraphs")
def chunk_bytes(spark, d):
    return chunking.by_weight(paragraphs(spark, d), ["doc_id"], "input_pos", "octet_length(text)", 4096, 50)


# Translation

@query(f"SELECT doc_id, id, CASE WHEN category IS NULL OR category IN {IN_SET} THEN CASE WHEN trim(text)='' THEN text ELSE concat('[translated]', text) END END AS translated_text FROM v_paragraphs", "v_paragraphs")
def mock_translate(spark, d):
    return translate.translate_paragraphs(paragraphs(spark, d), translate.MockBackend(), "en", "ja").select("doc_id", "id", "translated_text")


class _FlakyBackend(translate.MockBackend):
    """Texts of which the length is a multiple of seven fail in the first run."""

    name = "flaky"

    def __init__(self, failing: bool):
        super().__init__()
        self.failing, self.concurrency, self.batch_size = failing, 4, 1

    def translate_batch(self, texts, source, target):
        if self.failing and any(len(x) % 7 == 0 for x in texts):
            raise translate.ConfigurationError("refused")
        return super().translate_batch(texts, source, target)


@query(f"""SELECT sha256(concat_ws(chr(31), 'flaky', 'en', 'ja', text)) AS key, concat('[translated]', text) AS result, CASE WHEN length(text)%7=0 THEN 2 ELSE 1 END AS asked, CASE WHEN length(text)%7=0 THEN 'ConfigurationError' END AS first_error
 FROM (SELECT DISTINCT text FROM v_paragraphs WHERE (category IS NULL OR category IN {IN_SET}) AND trim(text)<>'')""", "v_paragraphs")
def translate_cached(spark, d):
    """Two runs over the same paragraphs: the second one asks for what failed in the first, and every different text has one answer."""
    cache = translation_cache.TranslationCache(spark, scratch.shared_folder(spark, "translations"))
    p = paragraphs(spark, d).where("trim(text) <> ''")
    for run in ("1", "2"):
        translation_cache.translate_cached(p, _FlakyBackend(run == "1"), "en", "ja", cache, run, size=1000)
    first = cache.rows().where("run = '1'").select("key", F.col("error_class").alias("first_error"))
    return cache.outcomes().join(first, "key", "left").select("key", "result", "asked", "first_error")


@query("""WITH l(prefix, lim) AS (VALUES ('promo', 10), ('PROMO B', 11), ('STANDARD', 20), ('ECONOMY', 30), ('ECONOMY A', 31), ('SMALL', 40))
 SELECT p_partkey, p_type, coalesce((SELECT lim FROM l WHERE starts_with(upper(p_type), upper(prefix)) ORDER BY length(prefix) DESC LIMIT 1), 5) AS lim FROM part""")
def model_limit_prefix(spark, d):
    limits = {"PROMO": 10, "PROMO B": 11, "STANDARD": 20, "ECONOMY": 30, "ECONOMY A": 31, "SMALL": 40}
    return translate.with_limit(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_type"), F.upper("p_type"), limits, 5, "lim")


# Tables

_ROWS = """WITH RECURSIVE i AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY -y0, pos) AS rn FROM v_grid),
 f AS (SELECT table_id, rn, y0 AS y, 0 AS row FROM i WHERE rn=1 UNION ALL SELECT i.table_id, i.rn, CASE WHEN abs(i.y0-f.y)<=5 THEN f.y ELSE i.y0 END, CASE WHEN abs(i.y0-f.y)<=5 THEN f.row ELSE f.row+1 END FROM f JOIN i ON i.table_id=f.table_id AND i.rn=f.rn+1),
 rw AS (SELECT i.*, f.row, row_number() OVER (PARTITION BY i.table_id, f.row ORDER BY x0, i.rn)-1 AS in_row FROM i JOIN f USING (table_id, rn)),
 gp AS (SELECT table_id, x0, lag(x0) OVER (PARTITION BY table_id ORDER BY x0) AS b FROM v_grid),
 ed AS (SELECT table_id, unnest(list_concat([min(x0)-5], coalesce(list((x0+b)/2 ORDER BY x0) FILTER (WHERE x0-b>20), []))) AS l, max(x0)+100 AS hi FROM gp GROUP BY table_id),
 cb AS (SELECT table_id, CAST(row_number() OVER w-1 AS INTEGER) AS col, l AS "left", coalesce(lead(l) OVER w, hi) AS "right" FROM ed WINDOW w AS (PARTITION BY table_id ORDER BY l)),
 ce AS (SELECT g.table_id, g.row, g.col, coalesce(string_agg(text, ' ' ORDER BY in_row),'') AS text FROM (SELECT DISTINCT rw.table_id, row, col, "left", "right" FROM rw JOIN cb USING (table_id)) g
  LEFT JOIN rw r ON r.table_id=g.table_id AND r.row=g.row AND (r.x0+r.x1)/2>=g."left" AND (r.x0+r.x1)/2<g."right" GROUP BY 1,2,3)"""


@query(_ROWS + " SELECT table_id, pos, row, in_row FROM rw", "v_grid")
def table_row_cluster(spark, d):
    return tables.cluster_rows(spark_view(spark, d, "v_grid")).select("table_id", "pos", "row", "in_row")


@query(_ROWS + ' SELECT table_id, col, "left", "right" FROM cb', "v_grid")
def table_column_bounds(spark, d):
    return tables.column_bounds(spark_view(spark, d, "v_grid"))


@query(_ROWS + " SELECT table_id, row, col, text, row=0 AS is_header FROM ce", "v_grid")
def table_cells(spark, d):
    return tables.cells(spark_view(spark, d, "v_grid"))


@query(_ROWS + """, ln AS (SELECT table_id, row, concat('| ', string_agg(replace(text,'|',concat(chr(92),'|')), ' | ' ORDER BY col), ' |') AS line, count(*) AS n FROM ce GROUP BY 1,2)
 SELECT table_id, string_agg(CASE WHEN row=0 THEN concat(line, chr(10), '|', repeat(' --- |', n)) ELSE line END, chr(10) ORDER BY row) AS markdown FROM ln GROUP BY 1""", "v_grid")
def table_markdown(spark, d):
    return tables.to_markdown(table_cells(spark, d))


@query(_ROWS + """, ln AS (SELECT table_id, row, concat('  <tr>', chr(10), string_agg(concat('    <', tg, '>', replace(replace(text,'<','&lt;'),'>','&gt;'), '</', tg, '>'), chr(10) ORDER BY col), chr(10), '  </tr>') AS line FROM (SELECT *, CASE WHEN row=0 THEN 'th' ELSE 'td' END AS tg FROM ce) GROUP BY 1,2)
 SELECT table_id, concat('<table>', chr(10), string_agg(line, chr(10) ORDER BY row), chr(10), '</table>') AS html FROM ln GROUP BY 1""", "v_grid")
def table_html(spark, d):
    return tables.to_html(table_cells(spark, d))


@query(_ROWS + " SELECT table_id, CASE WHEN max(row)+1>=2 AND max(col)+1>=2 THEN 'heuristic' ELSE 'image' END AS method FROM ce GROUP BY 1", "v_grid")
def table_methods(spark, d):
    return tables.methods(table_cells(spark, d))


# Extraction


def pages(spark: SparkSession, d: str) -> DataFrame:
    """One page a document; a block for each line of its text, lines of eight words, a span for each word."""
    span = "named_struct('text', concat(w, ' '), 'rotation', CASE WHEN doc_id%10=7 THEN radians(90D) ELSE 0D END, 'font', named_struct('size', CAST(10+2*CAST(l.s*8+i AS INT)%3 AS DOUBLE), 'weight', CASE WHEN (doc_id+l.s*8+i)%4=0 THEN 700 ELSE 400 END, 'name', element_at(array('Times-Roman','Helvetica','Courier-Bold'), CAST((doc_id+l.s*8+i)%3 AS INT)+1), 'flags', CASE WHEN (l.s*8+i)%5=0 THEN 64 ELSE 0 END))"
    lines = "transform(sequence(0, (size(ws)-1) div 8), s -> named_struct('s', s, 'ws', slice(ws, s*8+1, 8)))"
    line = f"transform(ls, l -> named_struct('bbox', array(50D+(doc_id%5)*l.s, 10D*l.s, 300D-(doc_id%3)*l.s, 10D*l.s+9), 'spans', transform(l.ws, (w, i) -> {span})))"
    rows = paragraphs(spark, d).withColumn("ws", F.split("text", " ")).withColumn("ls", F.expr(lines)).withColumn("lines", F.expr(line))
    block = F.struct("input_pos", F.expr("array(50D, CAST(input_pos AS DOUBLE), 300D, CAST(input_pos+20 AS DOUBLE))").alias("bbox"), "lines")
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    return docs.select("doc_id", F.array(F.struct(F.array(F.lit(0.0), F.lit(0.0), F.lit(600.0), F.lit(800.0)).alias("bbox"), F.lit(800.0).alias("height"), F.expr("transform(blocks, b -> named_struct('bbox', b.bbox, 'lines', b.lines))").alias("blocks"))).alias("pages"))


_S = "WITH s AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY block)-1 AS bl, CAST(10+(2*i)%3 AS DOUBLE) AS sz, length(text) AS w FROM v_spans)"


@query("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY input_pos)-1 AS block, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, 800-(input_pos+20)::DOUBLE AS y0, 800-input_pos::DOUBLE AS y1 FROM v_paragraphs", "v_paragraphs")
def extract_flatten(spark, d):
    return extract.paragraphs(pages(spark, d)).select("doc_id", F.col("block").cast("long").alias("block"), "text", "y0", "y1")


@query("SELECT doc_id, 4 AS page_number, count(*) AS blocks FROM v_paragraphs GROUP BY 1", "v_paragraphs")
def page_range_renumber(spark, d):
    return extract.select_pages(pages(spark, d), [4]).select("doc_id", "page_number", F.size("page.blocks").cast("long").alias("blocks"))


@query(_S + " SELECT doc_id, bl AS block, sz AS font_size FROM (SELECT doc_id, bl, sz, sum(w) AS w FROM s GROUP BY 1,2,3) QUALIFY row_number() OVER (PARTITION BY doc_id, bl ORDER BY w DESC, sz)=1", "v_spans")
def font_size_mode(spark, d):
    return extract.paragraphs(pages(spark, d)).select("doc_id", F.col("block").cast("long").alias("block"), F.col("original_font_size").alias("font_size"))


@query(_S + " SELECT doc_id, bl AS block, name AS font_name FROM (SELECT doc_id, bl, name, sum(w) AS w, min(i) AS f FROM s GROUP BY 1,2,3) QUALIFY row_number() OVER (PARTITION BY doc_id, bl ORDER BY w DESC, f)=1", "v_spans")
def font_name_mode(spark, d):
    return extract.paragraphs(pages(spark, d)).select("doc_id", F.col("block").cast("long").alias("block"), "font_name")


@query(_S + " SELECT doc_id, bl AS block, sum(CASE WHEN weight>=700 OR lower(name) LIKE '%bold%' THEN w ELSE 0 END)*2>sum(w) AS is_bold, sum(CASE WHEN flags=64 THEN w ELSE 0 END)*2>sum(w) AS is_italic FROM s GROUP BY 1,2", "v_spans")
def bold_italic_vote(spark, d):
    return extract.paragraphs(pages(spark, d)).select("doc_id", F.col("block").cast("long").alias("block"), "is_bold", "is_italic")


@query(_S + " SELECT DISTINCT doc_id, bl AS block, CASE WHEN doc_id%10=7 THEN 90 ELSE 0 END AS degrees FROM s", "v_spans")
def rotation_mode(spark, d):
    return extract.paragraphs(pages(spark, d)).select("doc_id", F.col("block").cast("long").alias("block"), F.round("rotation").cast("int").alias("degrees"))


@query(_S + """, l AS (SELECT DISTINCT doc_id, bl, line_no AS s FROM s), e AS (SELECT doc_id, bl, count(*) AS n, 50+(doc_id%5)*min(s) AS l0, list(50+(doc_id%5)*s ORDER BY s) AS ls, list(300-(doc_id%3)*s ORDER BY s) AS rs, list((50+(doc_id%5)*s+300-(doc_id%3)*s)/2 ORDER BY s) AS cs FROM l GROUP BY doc_id, bl)
 SELECT doc_id, bl AS block, CASE WHEN doc_id%10=7 THEN 'left' WHEN n=1 THEN 'center' WHEN list_max(ls)-list_min(ls)<5 AND list_max(rs)-list_min(rs)<5 THEN 'justify' WHEN list_max(ls)-list_min(ls)<5 THEN 'left'
 WHEN n>=4 AND list_max(ls[2:n-1])-list_min(ls[2:n-1])<5 THEN 'left' WHEN list_max(rs)-list_min(rs)<5 AND list_max(ls)-list_min(ls)>20 THEN 'right' WHEN list_max(cs)-list_min(cs)<10 THEN 'center' ELSE 'left' END AS alignment FROM e""", "v_spans")
def alignment(spark, d):
    return extract.paragraphs(pages(spark, d)).select("doc_id", F.col("block").cast("long").alias("block"), "alignment")


@query("""SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%mono%' OR lower(p_name) LIKE '%courier%' THEN CASE WHEN p_size%2=0 AND p_size%3=0 THEN 'Courier-BoldOblique' WHEN p_size%2=0 THEN 'Courier-Bold' WHEN p_size%3=0 THEN 'Courier-Oblique' ELSE 'Courier' END
 WHEN lower(p_name) LIKE '%book%' OR lower(p_name) LIKE '%roman%' OR lower(p_name) LIKE '%times%' THEN CASE WHEN p_size%2=0 AND p_size%3=0 THEN 'Times-BoldItalic' WHEN p_size%2=0 THEN 'Times-Bold' WHEN p_size%3=0 THEN 'Times-Italic' ELSE 'Times-Roman' END
 ELSE CASE WHEN p_size%2=0 AND p_size%3=0 THEN 'Helvetica-BoldOblique' WHEN p_size%2=0 THEN 'Helvetica-Bold' WHEN p_size%3=0 THEN 'Helvetica-Oblique' ELSE 'Helvetica' END END AS font
 FROM (SELECT p_partkey, p_size, concat(p_name, CASE p_partkey%4 WHEN 0 THEN ' Mono Times' WHEN 1 THEN ' BookAntiqua' ELSE '' END) AS p_name FROM part)""")
def font_fallback(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").withColumn("name", F.expr("concat(p_name, CASE p_partkey%4 WHEN 0 THEN ' Mono Times' WHEN 1 THEN ' BookAntiqua' ELSE '' END)"))
    return part.select("p_partkey", documents.fallback_font(F.col("name"), F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0).alias("font"))


@query("SELECT 'd' || CAST(doc_id AS VARCHAR) AS doc_id, page_number, count(*) AS paragraphs, string_agg(text, chr(10) ORDER BY input_pos) AS text FROM v_paragraphs WHERE page_number IN (0, 2, 3) GROUP BY 1, 2", "v_paragraphs")
def page_scan(spark, d):
    """Pages as page files, of which the source reads three by their number."""
    p = paragraphs(spark, d)
    rows = p.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("input_pos", "page_number", "text"))).alias("ps"))
    # pages without paragraphs are pages, too
    numbered = F.expr("transform(sequence(0, array_max(transform(ps, p -> p.page_number))), n -> to_json(struct(transform(filter(ps, p -> p.page_number = n), p -> p.text) AS texts)))")
    folder = scratch.shared_folder(spark, "pages")
    files.write_documents(rows.withColumn("content", page_source.file_content(numbered)), F.format_string("d%d.pages", "doc_id"), "content", folder)
    found = page_source.read_page_files(spark, folder, "0,2-3").withColumn("p", F.from_json("json", "texts array<string>"))
    return found.where("size(p.texts) > 0").select("doc_id", "page_number", F.size("p.texts").cast("long").alias("paragraphs"), F.array_join("p.texts", "\n").alias("text"))


@query("SELECT concat('d', CAST(doc_id AS VARCHAR), e) AS file, CASE WHEN e='.json' THEN n ELSE t END AS paragraphs FROM (SELECT doc_id, count(*) AS n FROM v_paragraphs GROUP BY 1) LEFT JOIN (SELECT doc_id, count(*) AS t FROM v_translations WHERE translated_text<>'' GROUP BY 1) USING (doc_id), (VALUES ('.json'), ('.ja.json')) v(e) WHERE e='.json' OR t IS NOT NULL", "v_paragraphs", "v_translations")
def document_files(spark, d):
    """A file for each base document and translation, written and read back."""
    stem, folder = F.format_string("d%d.pdf", "doc_id"), scratch.shared_folder(spark, "files")
    read = lambda path: spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_name", "/"), -1).alias("file"), F.col("value").alias("json"))
    base = lambda path: read(path).select("file", F.from_json("json", documents.BASE)["metadata"]["paragraph_count"].cast("long").alias("paragraphs"))
    ja = lambda path: read(path).select("file", F.size(F.from_json("json", documents.TRANSLATION)["paragraphs"]).cast("long").alias("paragraphs"))
    # base documents have nothing of the translations, so nothing is joined for them
    made = files.written_and_read(documents.base_documents(paragraphs(spark, d), "en"), files.base_name(stem), "json", f"{folder}/base", base)
    return made.unionByName(files.written_and_read(documents.translation_documents(translated(spark, d), "ja", "mock", "2024-01-01T00:00:00"), files.translation_name(stem, "ja"), "json", f"{folder}/ja", ja))


# Fitting


@query()
def wrap_text(spark, d):
    from .operators import fit

    return fit.wrap(paragraphs(spark, d), 10.0)


@query()
def fit_text(spark, d):
    from .operators import fit

    return fit.fit(paragraphs(spark, d)).select("doc_id", "id", "font_size", "fits", "total_height", F.size("lines").alias("lines"))


@query("""SELECT doc_id, id, CASE rot WHEN 90 THEN x0 - (ly-y1) WHEN 270 THEN x1 + (ly-y1) ELSE x0 + lx END AS x, CASE rot WHEN 90 THEN y1 - lv WHEN 270 THEN y0 + lv ELSE ly END AS y FROM (
 SELECT *, CASE al WHEN 'center' THEN (x1-x0-w)/2 WHEN 'right' THEN x1-x0-w ELSE 0 END AS lx, CASE al WHEN 'center' THEN (y1-y0-w)/2 WHEN 'right' THEN y1-y0-w ELSE 0 END AS lv FROM (
 SELECT *, CAST(input_pos%50 AS DOUBLE) AS w, y1-10 AS ly, CASE doc_id%3 WHEN 0 THEN 0 WHEN 1 THEN 90 ELSE 270 END AS rot, CASE input_pos%3 WHEN 0 THEN 'left' WHEN 1 THEN 'center' ELSE 'right' END AS al FROM v_paragraphs))""", "v_paragraphs")
def line_placement(spark, d):
    from .operators import fit

    p = paragraphs(spark, d).selectExpr("*", "CAST(input_pos%50 AS DOUBLE) AS width", "y1-10 AS y_position", "CAST(CASE doc_id%3 WHEN 0 THEN 0 WHEN 1 THEN 90 ELSE 270 END AS DOUBLE) AS rotation", "CASE input_pos%3 WHEN 0 THEN 'left' WHEN 1 THEN 'center' ELSE 'right' END AS alignment")
    return fit.place_lines(p).select("doc_id", "id", "x", "y")


# Objects, regions and drawing


def core_json(spark: SparkSession, d: str) -> DataFrame:
    """A core document for each document: its paragraphs as text objects."""
    p = paragraphs(spark, d).withColumn("pos", F.col("input_pos"))
    font = F.struct(F.expr("element_at(array('Times-Roman','Nimbus-Medi','Courier-BoldOblique'), CAST((doc_id+input_pos)%3 AS INT)+1)").alias("name"), F.col("original_font_size").alias("size"), F.col("is_bold"), F.col("is_italic"))
    objects = p.select("doc_id", "page_number", "pos", "id", "text", "x0", "y0", "x1", "y1", font.alias("font"), F.expr("CAST(NULL AS STRUCT<r:INT,g:INT,b:INT>)").alias("color"),
                       F.expr("named_struct('a', 1D, 'b', 0D, 'c', 0D, 'd', 1D, 'e', CAST(input_pos%2 AS DOUBLE), 'f', 0D)").alias("transform"))
    pages_ = p.select("doc_id", "page_number", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.lit(0).alias("rotation")).distinct()
    meta = p.groupBy("doc_id").agg(F.struct(F.lit("a.pdf").alias("source_file"), F.lit("2024-01-01").alias("created_at"), (F.max("page_number") + 1).alias("page_count")).alias("metadata"))
    return sources.core_documents(objects, pages_, meta)


@query("SELECT doc_id, page_number, id, text, x0, y1 FROM v_paragraphs", "v_paragraphs")
def core_json_roundtrip(spark, d):
    return sources.text_objects(sources.parse_core(core_json(spark, d))).select("doc_id", "page_number", "id", "text", "x0", "y1")


@query("SELECT doc_id, id, (doc_id+input_pos)%3<>0 AS is_bold, (doc_id+input_pos)%3=2 AS is_italic, input_pos%2=1 AS moved FROM v_paragraphs", "v_paragraphs")
def object_attributes(spark, d):
    found = sources.attributes(sources.text_objects(sources.parse_core(core_json(spark, d))))
    return found.select("doc_id", "id", "is_bold", "is_italic", F.col("transform").isNotNull().alias("moved"))


@query("SELECT doc_id, page_number, string_agg(text, ' ' ORDER BY -y1, x0, input_pos) AS text FROM v_paragraphs WHERE (x0+x1)/2 BETWEEN 0 AND 320 AND (y0+y1)/2 BETWEEN 300 AND 800 GROUP BY 1,2", "v_paragraphs")
def region_text(spark, d):
    p = paragraphs(spark, d).withColumn("pos", F.col("input_pos"))
    region = p.select("doc_id", "page_number").distinct().selectExpr("*", "'r' AS region_id", "0D AS x0", "300D AS y0", "320D AS x1", "800D AS y1")
    return sources.region_text(p, region).drop("region_id")


@query("SELECT doc_id, page_number, count(*) AS boxes, min(x0) AS x0 FROM v_paragraphs p JOIN v_translations v USING (doc_id, id) WHERE v.translated_text<>'' GROUP BY 1,2", "v_translations")
def page_boxes(spark, d):
    from .operators import drawing

    return drawing.page_boxes(translated(spark, d)).select("doc_id", "page_number", F.size("boxes").cast("long").alias("boxes"), F.expr("array_min(transform(boxes, b -> b.x0))").alias("x0"))


@query()
def draw_plan(spark, d):
    from .operators import drawing

    return drawing.draw_plan(translated(spark, d).withColumns({"rotation": F.lit(0.0), "alignment": F.lit("left")}))


def streams(spark: SparkSession, d: str) -> DataFrame:
    """A content stream for each page, and boxes over every third paragraph's place."""
    p = paragraphs(spark, d)
    op = "flatten(transform(array_sort(collect_list(struct(input_pos, x0, y0))), p -> array(named_struct('op', 'Tm', 'args', array(1D, 0D, 0D, 1D, CAST(p.input_pos*10 AS DOUBLE), p.y0)), named_struct('op', 'Tj', 'args', CAST(array() AS ARRAY<DOUBLE>)))))"
    none = "CAST(array() AS ARRAY<DOUBLE>)"
    return p.groupBy("doc_id", "page_number").agg(
        F.expr(f"concat(array(named_struct('op', 'BT', 'args', {none})), {op}, array(named_struct('op', 'ET', 'args', {none})))").alias("ops"),
        F.expr("collect_list(CASE WHEN input_pos % 3 = 0 THEN named_struct('x0', input_pos*10-1D, 'y0', y0-1, 'x1', input_pos*10+1D, 'y1', y0+1) END)").alias("boxes"),
    )


@query("""SELECT doc_id, page_number, count(*)*2+2-count(*) FILTER (WHERE input_pos%3=0) AS ops FROM v_paragraphs GROUP BY 1,2""", "v_paragraphs")
def content_stream_edit(spark, d):
    """Every paragraph is moved to and shown; those at every third position lie in a box."""
    from .operators import drawing

    return drawing.edit_stream(streams(spark, d)).select("doc_id", "page_number", F.size("ops").cast("long").alias("ops"))


@query("SELECT doc_id, id FROM v_paragraphs WHERE input_pos % 4 <> 1", "v_paragraphs")
def remove_by_id(spark, d):
    from .operators import drawing

    p = paragraphs(spark, d)
    return drawing.remove_objects(p, p.where("input_pos % 4 = 1").select("doc_id", "page_number", "id")).select("doc_id", "id")


@query("SELECT doc_id, id, CAST(floor(greatest(x0-2,0)*2) AS INTEGER) AS left_px, CAST(floor((800-y1-2)*2) AS INTEGER) AS top_px FROM v_paragraphs WHERE x1-x0>=230 AND y1-y0>=90", "v_paragraphs")
def block_crops(spark, d):
    p = paragraphs(spark, d).withColumns({"page_width": F.lit(600.0), "page_height": F.lit(800.0)})
    return geometry.crops(p, 144.0, 2.0, 230.0, 90.0).select("doc_id", "id", F.col("left").alias("left_px"), F.col("top").alias("top_px"))


@query("SELECT doc_id, least(1, max(page_number)) AS page, CAST(0.25 AS DOUBLE) AS scale, 200 AS height FROM v_paragraphs GROUP BY 1", "v_paragraphs")
def thumbnail_geometry(spark, d):
    docs = paragraphs(spark, d).groupBy("doc_id").agg((F.max("page_number") + 1).alias("page_count")).withColumns({"page_width": F.lit(600.0), "page_height": F.lit(800.0)})
    return geometry.thumbnails(docs, 1, 150)


@query("SELECT is_bold, is_italic, substr(sha256(concat('font:0:', string_agg(ch, '' ORDER BY ch))), 1, 16) AS cache_key FROM (SELECT DISTINCT is_bold, is_italic, unnest(string_split(text, '')) AS ch FROM v_paragraphs) GROUP BY 1,2", "v_paragraphs")
def subset_cache_keys(spark, d):
    return summary.subset_keys(summary.charsets(paragraphs(spark, d), "", ()), "font")


@query(f"SELECT is_bold, is_italic, substr(sha256(concat('font:0:', string_agg(ch, '' ORDER BY ch))), 1, 16) AS cache_key FROM (SELECT DISTINCT is_bold, is_italic, unnest(list_concat(string_split(text, ''), string_split('{summary.MARGIN}', ''))) AS ch FROM v_paragraphs) GROUP BY 1,2", "v_paragraphs")
def subset_margin_keys(spark, d):
    return summary.subset_keys(summary.charsets(paragraphs(spark, d), keys=()), "font")


@query("SELECT category, CASE WHEN a>0 AND b>0 THEN 'common' WHEN a>0 THEN 'only model_a' ELSE 'only model_b' END AS side FROM (SELECT coalesce(category,'none') AS category, count(*) FILTER (WHERE doc_id%2=0) AS a, count(*) FILTER (WHERE doc_id%2=1) AS b FROM v_paragraphs GROUP BY 1)", "v_paragraphs")
def category_sets(spark, d):
    return evaluate.category_sets(category_comparison(spark, d), "model_a", "model_b")


@query("SELECT doc_id, id, CAST(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY input_pos) AS BIGINT) AS done, CAST(sum(length(text)) OVER (PARTITION BY doc_id) AS BIGINT) AS total FROM v_paragraphs", "v_paragraphs")
def progress_counter(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id")
    n = F.sum(F.length("text"))
    return paragraphs(spark, d).select("doc_id", "id", n.over(w.orderBy("input_pos")).alias("done"), n.over(w).alias("total"))


@query("SELECT doc_id, string_agg(text, chr(10) ORDER BY input_pos) AS text FROM v_paragraphs GROUP BY 1", "v_paragraphs")
def document_text(spark, d):
    return summary.document_text(paragraphs(spark, d))


@query("SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(h1|p|li|footer|title)>', 1)) AS tag FROM pages) GROUP BY 1,2")
def page_elements(spark, d):
    tags = F.explode(F.regexp_extract_all("html", F.lit("<(h1|p|li|footer|title)>"), 1)).alias("tag")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", tags).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, CAST(round(sum(value)) AS BIGINT) AS total FROM events GROUP BY 1,2")
def event_windows(spark, d):
    """An extension: hourly windows, as the stream makes them."""
    from .streaming import landing

    out = landing.windowed_counts(spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("total").cast("long").alias("total"))


@query()
def translate_corpus(spark, d):
    """The whole pipeline with the mock backend; the Markdown."""
    from .plans import pipeline

    p = paragraphs(spark, d)
    return pipeline.run(p, spark_view(spark, d, "v_blocks"), translate.MockBackend(), pipeline.PipelineConfig(), lambda name, df: df).markdown


# Tables on pages, listings and names


@query("SELECT concat(CAST(b.doc_id AS VARCHAR), '/', CAST(b.page_number AS VARCHAR), '/', b.block_id) AS table_id, CAST(o.input_pos AS BIGINT) AS pos, o.text FROM v_blocks b JOIN v_paragraphs o ON b.doc_id=o.doc_id AND b.page_number=o.page_number AND o.x0>=b.x0-5 AND o.x1<=b.x1+5 AND o.y0>=b.y0-5 AND o.y1<=b.y1+5 WHERE b.raw_category='text'", "v_blocks")
def objects_in_tables(spark, d):
    objects = paragraphs(spark, d).withColumn("pos", F.col("input_pos").cast("long"))
    return tables.objects_in_tables(objects, spark_view(spark, d, "v_blocks").where("raw_category = 'text'")).select("table_id", "pos", "text")


@query("SELECT l_orderkey AS table_id, bool_or(l_linenumber=7 OR l_quantity>49) AS is_complex FROM lineitem GROUP BY 1")
def complex_merges(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return tables.complex_merges(rows.selectExpr("l_orderkey AS table_id", "CASE WHEN l_linenumber = 7 THEN 2 END AS rowspan", "CASE WHEN l_quantity > 49 THEN 3 ELSE 1 END AS colspan"))


@query("SELECT category, count(*) AS n FROM v_paragraphs GROUP BY 1", "v_paragraphs")
def category_listing(spark, d):
    return categories.listing(paragraphs(spark, d))


@query("SELECT doc_id, concat('table_', printf('%03d', row_number() OVER (PARTITION BY doc_id ORDER BY input_pos)), '.png') AS file, id FROM v_paragraphs WHERE category='table'", "v_paragraphs")
def asset_manifest(spark, d):
    blocks = paragraphs(spark, d).where(categories.table_block(F.col("category"))).withColumn("block_id", F.col("id"))
    return documents.asset_manifest(blocks, "table", "images").select("doc_id", F.substring_index("relative_path", "/", -1).alias("file"), F.col("layout_block_id").alias("id"))


@query("SELECT doc_id, page_number, string_agg(CAST(CAST(x0 AS INTEGER) AS VARCHAR)||','||CAST(CAST(y0 AS INTEGER) AS VARCHAR)||','||CAST(CAST(x1 AS INTEGER) AS VARCHAR)||','||CAST(CAST(y1 AS INTEGER) AS VARCHAR), ' ' ORDER BY x0, y0, x1, y1) AS boxes FROM v_paragraphs p JOIN v_translations v USING (doc_id, id) WHERE v.translated_text<>'' GROUP BY 1,2", "v_translations")
def page_box_list(spark, d):
    from .operators import drawing

    box = F.expr("array_join(transform(boxes, b -> concat_ws(',', CAST(b.x0 AS INT), CAST(b.y0 AS INT), CAST(b.x1 AS INT), CAST(b.y1 AS INT))), ' ')")
    return drawing.page_boxes(translated(spark, d)).select("doc_id", "page_number", box.alias("boxes"))


@query("SELECT doc_id, page_number, concat('BT ', string_agg(concat('Tm', CAST(input_pos*10 AS VARCHAR), ',', CAST(CAST(y0 AS INTEGER) AS VARCHAR), CASE WHEN input_pos%3=0 THEN '' ELSE ' Tj' END), ' ' ORDER BY input_pos), ' ET') AS ops FROM v_paragraphs GROUP BY 1,2", "v_paragraphs")
def content_stream_ops(spark, d):
    """As content_stream_edit, with every operation that stays and its place."""
    from .operators import drawing

    shown = "transform(ops, o -> CASE WHEN o.op = 'Tm' THEN concat('Tm', CAST(CAST(o.args[4] AS INT) AS STRING), ',', CAST(CAST(o.args[5] AS INT) AS STRING)) ELSE o.op END)"
    return drawing.edit_stream(streams(spark, d)).select("doc_id", "page_number", F.expr(f"array_join({shown}, ' ')").alias("ops"))


@query(f"SELECT doc_id, id, CASE (doc_id+input_pos)%3 WHEN 0 THEN 'Times-Roman' WHEN 1 THEN concat('Helvetica', CASE WHEN is_bold AND is_italic THEN '-BoldOblique' WHEN is_bold THEN '-Bold' WHEN is_italic THEN '-Oblique' ELSE '' END) ELSE 'Courier-BoldOblique' END AS font_name, original_font_size AS font_size, {_ASCII} AS text FROM v_paragraphs WHERE page_number<2", "v_paragraphs")
def template_plan(spark, d):
    """A template of two pages; the fonts are two standard ones and one that falls back."""
    from .operators import drawing

    p = paragraphs(spark, d)
    name = F.expr("element_at(array('Times-Roman','Odd-Face','Courier-BoldOblique'), CAST((doc_id+input_pos)%3 AS INT)+1)")
    objects = p.select("doc_id", "page_number", "id", "text", "x0", "y0", "x1", "y1", F.struct(name.alias("name"), F.col("original_font_size").alias("size"), "is_bold", "is_italic").alias("font"), F.expr("CAST(NULL AS STRUCT<r:INT,g:INT,b:INT>)").alias("color"), F.lit(None).cast("string").alias("transform"))
    return drawing.template_plan(objects, p.where("page_number < 2")).select("doc_id", "id", "font_name", "font_size", "text")


@query("SELECT doc_id, page_number, string_agg(text, ' ' ORDER BY -y1, x0, input_pos) AS text FROM v_paragraphs GROUP BY 1,2", "v_paragraphs")
def page_text(spark, d):
    return sources.page_text(paragraphs(spark, d).withColumn("pos", F.col("input_pos")))


@query("SELECT doc_id, id, text FROM v_paragraphs WHERE input_pos%5=2", "v_paragraphs")
def objects_by_id(spark, d):
    p = paragraphs(spark, d)
    ids = p.where("input_pos % 5 = 2").select("doc_id", "id")
    return sources.objects_by_id(p, ids.unionByName(ids)).select("doc_id", "id", "text")


@query("""SELECT DISTINCT concat('F', CAST(p_size AS VARCHAR), CASE WHEN p_size%3=0 THEN '-Regular' ELSE '' END, '.ttf') AS font, p_partkey%2=0 AS is_bold, p_partkey%3=0 AS is_italic,
 concat('F', CAST(p_size AS VARCHAR), CASE WHEN p_partkey%2=0 AND p_partkey%3=0 AND p_size%4=0 THEN 'BoldItalic.ttf' WHEN p_partkey%2=0 AND p_partkey%3<>0 AND p_size%5=0 THEN '-Bold.ttf' WHEN p_partkey%2=0 AND p_partkey%3<>0 AND p_size%7=0 THEN '-Medium.ttf'
  WHEN p_partkey%2=1 AND p_partkey%3=0 AND p_size%2=0 THEN '-Oblique.ttf' WHEN p_size%3=0 THEN '-Regular.ttf' ELSE '.ttf' END) AS file FROM part""")
def style_variant(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    made = "inline(filter(array(named_struct('ok', p_size%4=0, 'e', 'BoldItalic'), named_struct('ok', p_size%5=0, 'e', '-Bold'), named_struct('ok', p_size%7=0, 'e', '-Medium'), named_struct('ok', p_size%2=0, 'e', '-Oblique')), x -> x.ok))"
    fonts = part.select("p_size").distinct().selectExpr("p_size", made).selectExpr("concat('F', CAST(p_size AS STRING), e, '.ttf') AS file")
    wanted = part.selectExpr("concat('F', CAST(p_size AS STRING), CASE WHEN p_size%3=0 THEN '-Regular' ELSE '' END, '.ttf') AS font", "p_partkey%2=0 AS is_bold", "p_partkey%3=0 AS is_italic")
    return sources.style_variant(fonts, wanted)
