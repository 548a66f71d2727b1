"""Page files that are read in parts, and files of documents that come whole or not at all."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quirework.operators import documents
from quirework.sources import files, pages, scratch


def made(tmp_path, docs=6, each=9, size=200):
    for d in range(docs):
        (tmp_path / f"d{d}.pages").write_bytes(pages.encode([json.dumps({"doc": d, "page": p, "text": "é" * size}) for p in range(each)]))
    return str(tmp_path)


def rows(df):
    return sorted((r.doc_id, r.page_number, json.loads(r.json)["page"]) for r in df.collect())


def test_pages_are_pruned(spark, tmp_path):
    df = pages.read_page_files(spark, made(tmp_path))
    everything = [(f"d{d}", p, p) for d in range(6) for p in range(9)]
    assert rows(df) == everything
    assert rows(df.where("page_number = 4")) == [r for r in everything if r[1] == 4] and rows(df) == everything
    for wanted, docs, keep in (
        ("3-5", None, lambda d, p: 3 <= p <= 5), ("7-", None, lambda d, p: p > 6), ("8,1,20,1-1", ["d2"], lambda d, p: p in (1, 8) and d == "d2"),
        (None, ["d0", "none"], lambda d, p: d == "d0"), ("", None, lambda d, p: False), ("-1, 4", None, lambda d, p: p in (0, 1, 4)),
    ):
        assert rows(pages.read_page_files(spark, str(tmp_path), wanted, docs)) == [r for r in everything if keep(*r[:2])], wanted


def test_partitions_are_spans_of_pages(spark, tmp_path):
    folder = made(tmp_path, 4, 10)
    size = os.path.getsize(f"{folder}/d0.pages")
    n = lambda *how: pages.read_page_files(spark, folder, *how).rdd.getNumPartitions()
    assert n(None, None, 10 * size) == 1 and n(None, None, 2 * size) == 2
    half = size // 2 + 50
    assert n(None, None, half) == 8 and len(rows(pages.read_page_files(spark, folder, None, None, half))) == 40
    assert n("0-2", None, half) == 4 and n(None, ["d3"], half) == 2


def test_only_wanted_pages_are_read(tmp_path):
    """Other pages may hold anything."""
    name = tmp_path / "x.pages"
    data = bytearray(pages.encode(['{"page": 0}', '{"page": 1}', '{"page": 2}']))
    data[-3:] = b"\xff\xff\xff"
    name.write_bytes(bytes(data))
    reader = pages.PageReader(str(tmp_path), 1 << 20, "0-1")
    (span,) = reader.partitions()
    (batch,) = reader.read(span)
    assert batch.column(1).to_pylist() == [0, 1]


def test_an_empty_folder_of_pages(spark, tmp_path):
    assert pages.read_page_files(spark, str(tmp_path)).collect() == []
    (tmp_path / "e.pages").write_bytes(pages.encode([]))
    assert pages.read_page_files(spark, str(tmp_path)).collect() == []


def test_page_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, '{"a": "é"}'), (1, 1, '{"b": 2}'), (2, 0, "{}")], "doc_id long, page_number int, json string")
    f = pages.page_files(df)
    files.write_documents(f, F.col("name"), "content", f"{tmp_path}/out")
    assert sorted(map(tuple, pages.read_page_files(spark, f"{tmp_path}/out").collect())) == [("1", 0, '{"a": "é"}'), ("1", 1, '{"b": 2}'), ("2", 0, "{}")]


def left(folder):
    return sorted(os.path.relpath(os.path.join(d, n), folder) for d, _, names in os.walk(folder) for n in names if not n.startswith("_SUCCESS"))


PARAGRAPHS = "doc_id long, id string, page_number int, text string, x0 double, y0 double, x1 double, y1 double, line_count int, original_font_size double, is_bold boolean, is_italic boolean, input_pos int, translated_text string"


def test_a_task_that_fails_once(tmp_path):
    """Two attempts of a task in a session that tries again: whole files, and nothing of the first attempt. In a process of its
    own, as the tests' session has one attempt a task."""
    import subprocess
    import sys

    code = f"""
import os
from pyspark.sql import SparkSession, functions as F
from quirework.sources import files
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()

@F.udf("string")
def once(i):
    flag = "{tmp_path}/failed"
    if i == 25 and not os.path.exists(flag):
        open(flag, "w").close()
        raise ValueError("once")
    return "text %d" % i

df = spark.range(0, 40, 1, 4).select(F.format_string("d%d.json", "id").alias("name"), once("id").alias("content"))
files.write_documents(df, F.col("name"), "content", "{tmp_path}/out")
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=200, capture_output=True)
    assert os.path.exists(f"{tmp_path}/failed")
    assert left(f"{tmp_path}/out") == sorted(f"d{i}.json" for i in range(40))
    assert all(open(f"{tmp_path}/out/d{i}.json").read() == f"text {i}" for i in range(40)) and not any("attempt" in d for d in os.listdir(f"{tmp_path}/out"))


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    bad = spark.range(0, 40, 1, 4).select(F.format_string("d%d", "id").alias("name"), F.when(F.col("id") == 39, F.raise_error(F.lit("told to"))).otherwise(F.lit("x")).alias("content"))
    with pytest.raises(Exception, match="told to"):
        files.write_documents(bad, F.col("name"), "content", f"{tmp_path}/out")
    assert left(f"{tmp_path}/out") == [] and not any("attempt" in d for d in os.listdir(f"{tmp_path}/out"))
    with pytest.raises(Exception, match="no file can be called"):
        files.write_documents(spark.range(1).select(F.lit("../x").alias("name"), F.lit("x").alias("content")), F.col("name"), "content", f"{tmp_path}/out")


def test_documents_as_files(spark, tmp_path):
    p = spark.createDataFrame([(d, f"p{i}", 0, f"é {d} {i}", 0.0, 0.0, 1.0, 1.0, 1, 10.0, False, False, i, "ü") for d in range(5) for i in range(2)], PARAGRAPHS)
    base = documents.base_documents(p, "en")
    stem = F.format_string("sub%d/paper.v%d.pdf", F.col("doc_id") % 2, "doc_id")
    files.write_documents(base, files.base_name(stem), "json", str(tmp_path))
    files.write_documents(documents.translation_documents(p, "ja", "mock", "now"), files.translation_name(stem, "ja"), "json", str(tmp_path))
    assert left(str(tmp_path)) == sorted(f"sub{d % 2}/paper.v{d}{e}" for d in range(5) for e in (".json", ".ja.json"))
    assert all(open(f"{tmp_path}/sub{r.doc_id % 2}/paper.v{r.doc_id}.json", "rb").read() == r.json.encode() for r in base.collect())


def test_document_files_lie_on_the_disk_in_rounds(spark, tmp_path, monkeypatch):
    """All files are written and read back, and never more than about a quarter lies there; none is left at the end."""
    import __spark_entry__ as entry

    rows = [(i, f"title {i}\nfirst é\nsecond | cell\nthird\nfourth") for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    seen, most, write = {}, [], files.write_documents

    def watched(*args):
        write(*args)
        found = [os.path.join(d, n) for d, _, names in os.walk(f"{tmp_path}/shared a%20b") for n in names if n.endswith(".json")]
        most.append(len(found))
        for f in found:
            seen.setdefault(os.path.basename(f), json.load(open(f)))

    monkeypatch.setattr(files, "write_documents", watched)
    monkeypatch.setattr(files, "STORED", 10, raising=False)
    monkeypatch.setattr(scratch, "shared_folder", lambda _, name: f"{tmp_path}/shared a%20b/{name}")
    got = {r.file: r.paragraphs for r in entry.queries()["document_files"](spark, str(tmp_path)).collect()}
    assert {f"d{i}.json" for i in range(120)} < set(got) == set(seen)
    assert all(got[f] == len(x["paragraphs"]) for f, x in seen.items()) and all(got[f"d{i}.json"] == 5 for i in range(120))
    assert max(most) <= 30 and sum(most) == len(got)
    assert [n for _, _, names in os.walk(f"{tmp_path}/shared a%20b") for n in names if n.endswith(".json")] == []


def test_no_documents_are_no_files(spark, tmp_path):
    none = spark.createDataFrame([], "name string, json string")
    read = lambda path: spark.read.text(path, wholetext=True).select(F.length("value").alias("n"))
    found = files.written_and_read(none, F.col("name"), "json", f"{tmp_path}/none", read)
    assert found.columns == ["n"] and found.collect() == []
