"""Summaries from layout, and the characters a document's fonts need."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .translate import ConfigurationError, QuotaError


def _joined(rows: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["text"]), sep)


def layout_summary(paragraphs: DataFrame, title: str = "doc_title", abstract: str = "abstract", generated: DataFrame | None = None) -> DataFrame:
    """(doc_id, title, abstract, organization, sources): from layout; ``generated`` (doc_id, title, abstract,
    organization), such as a model's, fills what layout leaves empty, and organization always."""
    place = F.struct("page_number", (-F.col("y1")).alias("k"), "input_pos", "text")
    some = lambda c: F.nullif(_joined(F.when((F.col("category") == c) & (F.col("text") != ""), place), "\n\n"), F.lit(""))
    found = paragraphs.groupBy("doc_id").agg(some(title).alias("t"), some(abstract).alias("a"))
    if generated is None:
        found = found.withColumns({c: F.lit(None).cast("string") for c in ("gt", "ga", "organization")})
    else:
        found = found.join(generated.select("doc_id", F.col("title").alias("gt"), F.col("abstract").alias("ga"), "organization"), "doc_id", "left")
    # the source is layout unless a model's text stands in; an empty one does not
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    source = lambda own, other: F.when(F.col(own).isNull() & given(other).isNotNull(), "llm").otherwise("layout")
    return found.select(
        "doc_id", F.coalesce("t", given("gt")).alias("title"), F.coalesce("a", given("ga")).alias("abstract"), "organization",
        source("t", "gt").alias("title_source"), source("a", "ga").alias("abstract_source"),
    )


def base_summaries(paragraphs: DataFrame, markdown: DataFrame | None = None, ask: Callable[[str], str] | None = None, language: str | None = None, fallback: bool = False, write: bool = False) -> DataFrame:
    """(doc_id, title, abstract, organization, summary, page_count, title_source, abstract_source): from layout; with ``ask``, a
    language model fills gaps from the first page (``fallback``) and writes a summary of ``markdown`` (doc_id, markdown)
    in ``language`` (``write``). The model is asked once a document for each, so write the result before using it twice."""
    from . import backends

    pages = paragraphs.groupBy("doc_id").agg((F.max("page_number") + 1).cast("int").alias("page_count"))
    made = None
    if ask is not None and (fallback or write):
        first = first_page_text(paragraphs).withColumnRenamed("text", "first_page") if fallback else pages.select("doc_id", F.lit(None).cast("string").alias("first_page"))
        given = pages.select("doc_id").join(first, "doc_id", "left")
        given = given.join(markdown, "doc_id", "left") if write and markdown is not None else given.withColumn("markdown", F.lit(None).cast("string"))
        made = backends.generated(given, ask, language)
    found = layout_summary(paragraphs, generated=made)
    said = pages.withColumn("summary", F.lit(None).cast("string")) if made is None else pages.join(made.select("doc_id", "summary"), "doc_id", "left")
    return found.join(said, "doc_id").select("doc_id", "title", "abstract", "organization", "summary", "page_count", "title_source", "abstract_source")


def has_content(title: Column, abstract: Column, summary: Column, thumbnail: Column) -> Column:
    return F.coalesce(title, abstract, summary, thumbnail).isNotNull()


def first_page_text(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, text): the first page's paragraphs from the top, those without text left out, with blank lines between."""
    place = F.when(F.col("text") != "", F.struct((-F.col("y1")).alias("k"), "input_pos", "text"))
    return paragraphs.where("page_number = 0").groupBy("doc_id").agg(_joined(place, "\n\n").alias("text"))


def document_text(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.groupBy("doc_id").agg(_joined(F.struct("input_pos", "text"), "\n").alias("text"))


#: Fixed characters that every subset has besides those of its texts.
MARGIN = "。、！？「」『』（）…―　0123456789"


def charsets(paragraphs: DataFrame, margin: str = MARGIN, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, is_bold, is_italic, chars): the different characters of each document (or of other ``keys``) and style, with
    those of ``margin``, in code point order; styles without text have none.

    A paragraph's characters become bits in blocks of 64 code points, and blocks are joined by a bitwise or, map-side
    first: what moves is one row a block, not one a character."""
    points = F.array_distinct(F.transform(F.regexp_extract_all(F.concat("text", F.lit(margin)), F.lit("(?s)."), F.lit(0)), F.ascii))
    blocks = F.expr("transform(array_distinct(transform(points, p -> p div 64)), b -> struct(b AS block, aggregate(filter(points, p -> p div 64 = b), 0L, (bits, p) -> bits | shiftleft(1L, p % 64)) AS bits))")
    rows = paragraphs.where("text <> ''").select(*keys, "is_bold", "is_italic", points.alias("points")).select(*keys, "is_bold", "is_italic", F.inline(blocks))
    style = [*keys, "is_bold", "is_italic"]
    joined = rows.groupBy(*style, "block").agg(F.bit_or("bits").alias("bits"))
    text = F.expr("array_join(flatten(transform(array_sort(collect_list(struct(block, bits))), x -> transform(filter(sequence(0, 63), i -> shiftrightunsigned(x.bits, i) & 1 = 1), i -> char_of(x.block * 64 + i)))), '')".replace("char_of(x.block * 64 + i)", "decode(unhex(lpad(hex(x.block * 64 + i), 8, '0')), 'UTF-32')"))
    return joined.groupBy(*style).agg(text.alias("chars"))


def style_charsets(paragraphs: DataFrame, margin: str = MARGIN) -> DataFrame:
    """(is_bold, is_italic, ch): the different characters of the whole corpus by style, a row for each."""
    return charsets(paragraphs, margin, ()).select("is_bold", "is_italic", F.explode(F.regexp_extract_all("chars", F.lit("(?s)."), F.lit(0))).alias("ch"))


def subset_keys(charsets: DataFrame, identity: str, number: int = 0) -> DataFrame:
    """A cache key for each row of :func:`charsets`: 16 hex digits of a digest of font, number and sorted characters."""
    return charsets.select("*", F.substring(F.sha2(F.concat(F.lit(f"{identity}:{number}:"), "chars"), 256), 1, 16).alias("cache_key")).drop("chars")


def translated_summary(summaries: DataFrame, backend, source: str, target: str, write: Callable[[str], str] | None = None) -> DataFrame:
    """(doc_id, title, abstract, summary) in the target language; ``write`` makes the summary of ``markdown``. What
    fails is null, and documents of which all is null are left out; a refused key or a used-up quota is an error."""

    def attempt(f, x):
        try:
            return f(x) if x else None
        except (ConfigurationError, QuotaError):
            raise
        except Exception:
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = lambda x: backend.translate_batch([x], source, target)[0]
        for pdf in frames:
            made = [(r.doc_id, attempt(one, r.title), attempt(one, r.abstract), attempt(write, r.markdown) if write else None) for r in pdf.itertuples()]
            out = pd.DataFrame(made, columns=["doc_id", "title", "abstract", "summary"], dtype=object)
            yield out[out[["title", "abstract", "summary"]].notna().any(axis=1)]

    columns = summaries.select("doc_id", "title", "abstract", "markdown" if "markdown" in summaries.columns else F.lit(None).cast("string").alias("markdown"))
    return columns.mapInPandas(run, T.StructType([summaries.schema["doc_id"], *T.StructType.fromDDL("title string, abstract string, summary string")]))
