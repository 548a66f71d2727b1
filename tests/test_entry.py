import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


SERVICES = ["service_translations", "uneven_translations", "generated_summaries", "translated_summaries", "summary_sources", "model_replies", "text_object_scan", "layout_detections", "assets_by_place", "block_scan", "observed_counts", "document_charsets", "template_plan", "page_scan", "document_files", "translate_cached"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["markdown_original", "merge_paragraphs", "detect_columns", "assign_categories", "table_markdown", "split_long_text", "chunk_tokens", "alignment", "document_diff", *SERVICES])
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "lineitem", "part", "supplier", "pages", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    got = entry.queries()[name](spark, SF).toPandas()[list(want.columns)]
    rows = lambda df: sorted(map(repr, df.astype(object).where(df.notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_services_answer_long_and_odd_texts_whole(spark, tmp_path):
    """Texts of more than any service takes at once, blank ones, and ones with the characters and fences that requests and replies use."""
    import duckdb

    most = [5_000, 30_000, 32_000]
    long = ["word. " * 7_000, "x" * 70_000, " " * 6_000 + "end", *("y" * (n + k) for n in most for k in (-2, -1, 0, 1))]
    odd = ["  ", "\t", "a ```json {} ``` b", "```", "\x02", "a\x03b\x02\x1b1\x1b", "\x1b0\x1b\x1b2", "&=+%;", '"\\']
    # every text in several places, so that some are translatable
    rows = [(i, "\n".join([f"title {i}", x, x, "last"])) for i, x in enumerate([*long, *odd, *odd])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, id, backend, translated_text FROM ({entry.oracle_sql()['service_translations']})").fetchall())
    got = sorted(map(tuple, entry.queries()["service_translations"](spark, str(tmp_path)).select("doc_id", "id", "backend", "translated_text").collect()))
    assert got == want and {r[0] for r in want} == {r[0] for r in rows}


TABLES = ["table_row_cluster", "table_column_bounds", "table_cells", "table_markdown", "table_html", "table_methods"]


@pytest.mark.parametrize("name", TABLES)
def test_every_order_is_a_table(spark, tmp_path, name):
    rows = [(order, 7 * order + line, 3 * order, line, float(line), 10.0 * line) for order in range(1, 31) for line in range(1, order % 4 + 2)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = entry.queries()[name](spark, str(tmp_path)).select("table_id").distinct().collect()
    assert sorted(r.table_id for r in found) == list(range(1, 31))
