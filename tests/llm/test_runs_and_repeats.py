"""Runs as they lie, tables after a failure, and tables with repeated ids against the SQL."""

import random

import pytest
from pyspark.sql import functions as F

from quirework.llm import exact_dedup, line_dedup, ngram_join
from quirework.llm.workspace import Workspace, settings

from .helpers import deduped_lines, documents, prose

UNEVEN = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files(spark, ws, name):
    return sum(r.path.endswith(".parquet") for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(ws.path(name)).select("path").collect())


def test_a_bucket_is_one_sorted_file(spark):
    """With seven shuffle partitions that stay apart and three buckets: no run is sorted or shuffled again."""
    with settings(spark, UNEVEN), Workspace(spark, "t") as ws, line_dedup.LineRuns(ws, fanout=9, buckets=3) as runs:
        for k in range(3):
            runs.add(spark.range(k * 500, k * 500 + 2000).select("id", F.xxhash64(F.col("id") % 900).alias("h1"), F.xxhash64(F.lit(1), F.col("id") % 900).alias("h2")).withColumnRenamed("id", "doc_id"))
        names = runs.runs()
        assert [files(spark, ws, n) for n in names] == [3, 3, 3]
        with settings(spark, line_dedup.ORDERED):
            for df in (runs._merged(runs._table(names[0]), runs._table(names[1])), runs.anti(runs._table(names[2]).select(*line_dedup.KEY))):
                text = plan(df)
                assert "SortMergeJoin" in text and "Exchange" not in text and "Sort " not in text, text
        last = runs._compact(names)
        assert files(spark, ws, last) == 3 and runs._table(last).count() == 900 and runs._table(last).agg(F.sum("n_docs")).first()[0] == 6000


def test_no_table_stays_after_a_failure(spark, monkeypatch):
    rows = [(i, f"a line that is long enough to count {i % 3}") for i in range(30)]
    before = {t.name for t in spark.catalog.listTables()}
    monkeypatch.setattr(line_dedup.LineRuns, "frequent", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        line_dedup.dedup_lines(documents(spark, rows), Workspace(spark, "t"))
    assert {t.name for t in spark.catalog.listTables()} == before


def test_line_dedup_with_uneven_partitions(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choices([f"a line that is long enough to count {k}" for k in range(40)], k=rng.randrange(1, 9)))) for i in range(200)]
    with settings(spark, UNEVEN):
        got = {r.doc_id: (r.n_lines, r.text) for r in line_dedup.dedup_lines(documents(spark, rows), Workspace(spark, "t")).collect()}
    assert got == {i: (n, t) for i, n, t in deduped_lines(rows)}


def repeated(rng):
    line = "this line is long enough to go from here"
    rows = [(rng.randrange(9), rng.choice(["", "x", f"{line}\ny", f"{line} {rng.randrange(3)}", line])) for _ in range(60)]
    return rows + [(None, line), (None, line), (None, None), (3, None)]


@pytest.mark.parametrize("name", ["op5", "op9"])
def test_sql_with_repeated_ids(spark, tmp_path, name):
    import duckdb

    documents(spark, repeated(random.Random(2))).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    query, sql = (exact_dedup.op5_exact_dedup, exact_dedup.SQL) if name == "op5" else (line_dedup.op9_line_dedup, line_dedup.SQL)
    found = con.execute(sql)
    columns, want = [c[0] for c in found.description], found.fetchall()
    got = [tuple(r) for r in query(spark, str(tmp_path)).select(columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_exact_dedup_in_small_batches(spark, tmp_path):
    rows = repeated(random.Random(4))
    documents(spark, rows).repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    whole = exact_dedup.exact_dedup(spark, f"{tmp_path}/documents.parquet", Workspace(spark, "t"))
    stream = exact_dedup.DedupStream(spark, Workspace(spark, "t"))
    stream.advance(f"{tmp_path}/documents.parquet", files=1)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(stream.resolve(f"{tmp_path}/documents.parquet")) == key(whole) and whole.count() == len(rows)


def test_equal_rows_ship_one_text(spark):
    text = prose(random.Random(1), 80, 2000)
    ws = Workspace(spark, "t")
    kept = {}
    put, ws.put = ws.put, lambda name, df: kept.setdefault(name, put(name, df).cache()) if name == "texts" else put(name, df)
    got = ngram_join.ngram_components(documents(spark, [(1, text)] * 3000 + [(2, text + " tail")]), ws).collect()
    assert {r.component_id for r in got} == {1} and len(got) == 3001
    assert kept["texts"].count() == 2
