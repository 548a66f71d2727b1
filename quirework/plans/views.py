"""Synthetic layout over the driver's tables: paragraphs, blocks, translations, grids and spans, for both engines.

Nothing in the tables has boxes, so these views derive them from ids and positions, with whole numbers cast to double
last. They are inputs for the operators' semantics, not data about real pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PARAGRAPHS = """
SELECT doc_id, concat('para_p', CAST(page_number AS {str}), '_b', CAST(slot AS {str})) AS id, CAST(page_number AS INT) AS page_number, line AS text,
 CAST(CASE WHEN n=0 THEN 50 ELSE 50+250*col+(CASE WHEN doc_id%3=0 THEN 6*r ELSE 0 END) END AS DOUBLE) AS x0,
 CAST(CASE WHEN n=0 THEN 770 ELSE 760-100*r-(CASE WHEN k%4=0 THEN 90 WHEN k%31=5 THEN 104 ELSE 96 END) END AS DOUBLE) AS y0,
 CAST(CASE WHEN n=0 THEN 540 ELSE 50+250*col+(CASE WHEN doc_id%3=0 THEN 6*r ELSE 0 END) + (CASE WHEN len%7=0 THEN 180 ELSE 240-4*(len%3) END) END AS DOUBLE) AS x1,
 CAST(CASE WHEN n=0 THEN 790 ELSE 760-100*r END AS DOUBLE) AS y1,
 CAST(1 + len {div} 80 AS INT) AS line_count, CAST(CASE WHEN k%11=0 THEN 12 ELSE 10 END AS DOUBLE) AS original_font_size,
 CASE WHEN n=0 THEN 'doc_title' WHEN n%13=5 THEN 'paragraph_title' WHEN line LIKE '%|%' THEN 'table' WHEN k%17=0 THEN NULL
  WHEN k%19=0 THEN 'display_formula' WHEN n%23=7 THEN 'footnote' WHEN k%29=3 THEN 'aside_text' ELSE 'text' END AS category,
 CAST((CAST(doc_id AS INT)*7+n*3)%50+50 AS DOUBLE)/100 AS category_confidence, (n=0 OR n%13=5) AS is_bold, (n%9=4) AS is_italic, n AS input_pos
FROM (SELECT *, slot {div} 6 AS col, slot % 6 AS r FROM
 (SELECT *, n {div} 12 AS page_number, n % 12 AS slot FROM
  (SELECT doc_id, CAST(pos AS INT) AS n, line, CAST(doc_id AS INT)+CAST(pos AS INT) AS k, CAST(length(line) AS INT) AS len FROM ({lines}) WHERE length(line)>0)))
"""
_SPARK = {"str": "STRING", "div": "div", "lines": "SELECT doc_id, pos, line FROM documents LATERAL VIEW posexplode(split(text,'\\n')) e AS pos, line"}
_DUCK = {"str": "VARCHAR", "div": "//", "lines": "SELECT doc_id, unnest(range(len(string_split(text,chr(10))))) AS pos, unnest(string_split(text,chr(10))) AS line FROM documents"}

_BLOCKS = """
SELECT doc_id, page_number, concat('blk', CAST(input_pos AS {str}), '_', CAST(v AS {str})) AS block_id, raw_category, x0-pad AS x0, y0-pad AS y0, x1+pad AS x1, CASE WHEN v=0 THEN y1+pad WHEN v=1 THEN y0+(y1-y0)*3/5 ELSE y0+(y1-y0)*2/5 END AS y1,
 CAST((doc_id+input_pos)%50+50 AS DOUBLE)/100 AS confidence, CAST(input_pos*3+v AS BIGINT) AS block_pos
FROM (SELECT *, 0 AS v, 'text' AS raw_category, CAST(2 AS DOUBLE) AS pad FROM v_paragraphs
 UNION ALL SELECT *, 1, 'inline_formula', CAST(0 AS DOUBLE) FROM v_paragraphs WHERE (doc_id+input_pos)%5=0
 UNION ALL SELECT *, 2, 'table', CAST(0 AS DOUBLE) FROM v_paragraphs WHERE (doc_id+input_pos)%7=0) u
WHERE (doc_id+input_pos)%17<>0
"""
_TRANSLATIONS = """
SELECT doc_id, id, CASE WHEN input_pos%29=0 THEN '' ELSE concat('[translated]', text) END AS translated_text FROM v_paragraphs
WHERE (category IS NULL OR category IN ('text','vertical_text','abstract','aside_text','figure_title')) AND input_pos%13<>0
"""
_GRID = """
SELECT l_orderkey AS table_id, CAST(rn*3+c AS BIGINT) AS pos, CASE c WHEN 0 THEN CAST(l_partkey AS {str}) WHEN 1 THEN concat('<', CAST(l_suppkey AS {str}), '|') ELSE CAST(CAST(l_quantity AS INT) AS {str}) END AS text,
 CAST(100+120*c+(l_partkey*(c+1))%9 AS DOUBLE) AS x0, CAST(700-14*rn+(l_suppkey+c)%4 AS DOUBLE) AS y0, CAST(140+120*c+(l_partkey*(c+1))%9 AS DOUBLE) AS x1, CAST(709-14*rn+(l_suppkey+c)%4 AS DOUBLE) AS y1
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) g,
 (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2) cs
"""
_SPANS_DUCK = """
SELECT doc_id, n AS block, i // 8 AS line_no, i % 8 AS span_no, concat(w, ' ') AS text, 10 + 2*CAST(i%3=0 AS INT) AS size, CASE WHEN (doc_id+i)%4=0 THEN 700 ELSE 400 END AS weight, CASE WHEN i%5=0 THEN 64 ELSE 0 END AS flags,
 CASE (doc_id+i)%3 WHEN 0 THEN 'Times-Roman' WHEN 1 THEN 'Helvetica' ELSE 'Courier-Bold' END AS name, CASE WHEN doc_id%10=7 THEN 90 ELSE 0 END AS degrees, i
FROM (SELECT doc_id, n, unnest(ws) AS w, CAST(unnest(range(len(ws))) AS INT) AS i FROM (SELECT doc_id, input_pos AS n, string_split(text, ' ') AS ws FROM v_paragraphs))
"""
TEMPLATES = {"v_paragraphs": _PARAGRAPHS, "v_blocks": _BLOCKS, "v_translations": _TRANSLATIONS, "v_grid": _GRID}
NEEDS = {"v_blocks": ["v_paragraphs"], "v_translations": ["v_paragraphs"], "v_spans": ["v_paragraphs"]}
SOURCES = {"v_grid": "lineitem"}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = SOURCES.get(name, "documents")
    given = {n: spark_view(spark, sf_dir, n) for n in NEEDS.get(name, [])}
    given[source] = spark.read.parquet(f"{sf_dir.rstrip('/')}/{source}.parquet")
    text = TEMPLATES[name].format(**_SPARK)
    for n in given:
        text = text.replace(f"FROM {n}", "FROM {" + n + "}")
    return spark.sql(text, **given)


def duck(sql: str, *names: str) -> str:
    """``sql`` with the views it names as common table expressions."""
    order: list[str] = []
    for name in names:
        for n in (*NEEDS.get(name, []), name):
            if n not in order:
                order.append(n)
    ctes = [f"{n} AS ({(_SPANS_DUCK if n == 'v_spans' else TEMPLATES[n]).format(**_DUCK)})" for n in order]
    rest = sql.strip()
    if rest.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + rest[14:].strip()
    if rest.upper().startswith("WITH"):
        return "WITH " + ", ".join(ctes) + ", " + rest[4:].strip()
    return "WITH " + ", ".join(ctes) + " " + rest
