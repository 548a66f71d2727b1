"""A data source of page records that reads only the pages it is asked for.

A document is one file, ``<doc_id>.pages``: its first line is a JSON array of the places where its pages begin, counted from the end of that line, with the
place of the end; the pages' JSON follows, one after another. A reader seeks to the pages that it is asked for. Small
files share a partition; a file larger than that is split into spans of pages.

    spark.dataSource.register(PageSource)
    spark.read.format("pages").option("pages", "3-5").load(folder)"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENDING = ".pages"
#: Bytes of a partition, about.
PARTITION = 64 << 20
SCHEMA = "doc_id string, page_number int, json string"


def opened(path: str):
    """(file system, path on it): local paths, and what pyarrow knows by its scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def first_line(f) -> bytes:
    """The first line of an open file, with its end."""
    held = b""
    while b"\n" not in held and (more := f.read(1 << 16)):
        held += more
    return held[: held.index(b"\n") + 1]


def encode(pages: list[str]) -> bytes:
    parts = [p.encode() for p in pages]
    places = [0]
    for p in parts:
        places.append(places[-1] + len(p))
    return json.dumps(places).encode() + b"\n" + b"".join(parts)


class Span(InputPartition):
    """Pages [first, last) of some files; last is None for all."""

    def __init__(self, files: list[str], first: int = 0, last: int | None = None):
        self.files, self.first, self.last = files, first, last


class PageSource(DataSource):
    """Options: path; pages, a list such as ``0-4,7,10-``; docs, ids as a JSON array; partitionBytes.

    Pages and documents are options, not pushed filters: a reader that was pushed filters keeps them for later queries
    of the same DataFrame (Spark 4.1), which would then lose rows."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        docs = self.options.get("docs")
        return PageReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION)), self.options.get("pages"), json.loads(docs) if docs else None)


def ranges_of(text: str | None) -> list[tuple[int, int | None]] | None:
    """Half-open ranges of a list such as ``0-4,7,10-``, in order; None for all pages."""
    if text is None:
        return None
    out = []
    for part in filter(None, (x.strip() for x in text.split(","))):
        first, dash, last = part.partition("-")
        out.append((int(first or 0), None if dash and not last else int(last or first) + 1))
    return sorted(out, key=lambda r: r[0])


class PageReader(DataSourceReader):
    def __init__(self, path: str, partition: int, pages: str | None = None, docs: list[str] | None = None):
        self.path, self.partition, self.docs, self.ranges = path, partition, None if docs is None else set(docs), ranges_of(pages)

    def wanted(self, first: int, last: int) -> list[int]:
        """The wanted pages in [first, last)."""
        if self.ranges is None:
            return list(range(first, last))
        return sorted({n for a, b in self.ranges for n in range(max(a, first), last if b is None else min(b, last))})

    def partitions(self) -> list[Span]:
        from pyarrow import fs

        system, root = opened(self.path)
        found = [i for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and i.base_name.endswith(ENDING)]
        found = sorted((i for i in found if self.docs is None or i.base_name[: -len(ENDING)] in self.docs), key=lambda i: i.path)
        out, held, size = [], [], 0
        for i in found:
            if i.size > self.partition:
                with system.open_input_file(i.path) as f:
                    places = json.loads(first_line(f))
                span: list[int] = []
                for n in self.wanted(0, len(places) - 1):
                    if span and places[n + 1] - places[span[0]] > self.partition:
                        out.append(Span([i.path], span[0], span[-1] + 1))
                        span = []
                    span.append(n)
                if span:
                    out.append(Span([i.path], span[0], span[-1] + 1))
                continue
            if held and size + i.size > self.partition:
                out.append(Span(held))
                held, size = [], 0
            held.append(i.path)
            size += i.size
        if held:
            out.append(Span(held))
        return out or [Span([])]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if not span.files:
            return
        system, _ = opened(self.path)
        for path in span.files:
            with system.open_input_file(path) as f:
                head = first_line(f)
                places = json.loads(head)
                last = len(places) - 1 if span.last is None else min(span.last, len(places) - 1)
                some = self.wanted(span.first, last)
                texts = []
                for n in some:
                    f.seek(len(head) + places[n])
                    texts.append(f.read(places[n + 1] - places[n]).decode())
            if some:
                name = path.rpartition("/")[2][: -len(ENDING)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some, pa.int32()), pa.array(texts)], names=["doc_id", "page_number", "json"])


def read_page_files(spark: SparkSession, path: str, pages: str | None = None, docs: list[str] | None = None, partition: int = PARTITION) -> DataFrame:
    """(doc_id, page_number, json) of the page files under ``path``: ``pages`` (such as ``0-4,7,10-``) and documents ``docs`` alone
    are read, or all."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this module
    spark.dataSource.register(PageSource)
    reader = spark.read.format("pages").option("partitionBytes", str(partition))
    reader = reader if pages is None else reader.option("pages", pages)
    return (reader if docs is None else reader.option("docs", json.dumps(docs))).load(path)


def file_content(texts: Column) -> Column:
    """A page file of an array of pages' JSON."""
    places = F.aggregate(texts, F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.octet_length(x))))
    return F.concat(F.lit("["), F.array_join(F.transform(places, lambda x: x.cast("string")), ", "), F.lit("]\n"), F.array_join(texts, ""))


def page_files(pages: DataFrame) -> DataFrame:
    """(name, content) of (doc_id, page_number, json): a file for each document, for files.write_documents. Pages are numbered
    by their order; a document's pages are held in one row."""
    made = F.array_sort(F.collect_list(F.struct("page_number", "json")))
    texts = pages.groupBy("doc_id").agg(F.transform(made, lambda x: x["json"]).alias("texts"))
    return texts.select(F.concat(F.col("doc_id").cast("string"), F.lit(ENDING)).alias("name"), file_content(F.col("texts")).alias("content"))
