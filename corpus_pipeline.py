"""The corpus pipeline: documents are classified, deduplicated by line and by document, and packed.

Each stage works on all rows that the stage before it kept; every stage but the last returns the columns of documents.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import line_dedup, ngram_join, packing, quality
from quirework.llm.workspace import Workspace, table

#: The stages judge order-dependent models (a classifier, packing), which SQL can't express.
ORACLE_SQL = None


def _ready(spark: SparkSession) -> None:
    """Python workers that start from now on can import the package from where this file lies."""
    known, here = spark.sparkContext.environment, os.path.dirname(os.path.abspath(__file__))
    if here not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(x for x in (here, known.get("PYTHONPATH", "")) if x)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below 0.3) go.

    Null and empty texts score the share of label 1 among the labelled rows. Repeated rows fare alike, whatever their
    number; rows with a null doc_id are scored like others. All columns pass, and an empty table gives an empty table."""
    _ready(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents hold go, but for the one with the largest doc_id; n_chars, if there, follows the text.

    No row goes: a document without lines left, a null and an empty text are the empty text from here on. Rows that share
    a doc_id are one holder, and each keeps what it holds; a null doc_id is less than any other. All columns pass, those
    named n_lines and n_dropped too; an empty table gives an empty table."""
    _ready(spark)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "doc_id", "text")
    out = line_dedup.dedup_lines(rows, Workspace(spark, "lines"))
    follow = {"text": F.col("text"), "n_chars": F.length("text")}  # the text is moved once, not in ``row`` too
    return out.select(*[follow[f.name].cast(f.dataType).alias(f.name) if f.name in follow else F.col(f"row.`{f.name}`") for f in docs.schema])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that n-gram Jaccard links join, one row stays: that of least doc_id.

    Of rows that share that id and group one stays, too (see keep_one). Rows without doc_id, text or words stay all. All
    columns pass, and an empty table gives an empty table."""
    _ready(spark)
    return ngram_join.keep_one(docs, Workspace(spark, "near"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens.

    Null and empty texts are an end mark alone; rows that share a doc_id, or have none, are packed each by itself. Other
    columns are not read, and an empty table gives no rows."""
    _ready(spark)
    return packing.pack_documents(docs, Workspace(spark, "pack"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the table documents; each one's rows are written and read again by the next."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = ws.put(f"stage{i}", stage(spark, docs, sf_dir))
        if i:
            ws.drop(f"stage{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
