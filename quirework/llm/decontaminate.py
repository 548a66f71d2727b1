"""Benchmark decontamination by a distributed positional inverted index of the training documents.

The index is dealt by documents into shards of about SHARD words. A shard numbers its words through, one free place
between documents, and stores for each of its terms the places where it stands; it is built where the documents lie
and written as a table, which serves any number of test sets. A search reads the rows of the test set's terms and takes
shard by shard: of each phrase, the term with the shortest list proposes the starts, its places less its offset in the
phrase, and the lists of the other terms, from the rarest on, less their own offsets, are intersected with them. What is
left after the last term are the exact occurrences. Proximity search proposes a stretch around each place of the rarest
term, drops it as soon as a term has no place in it, and returns the shortest stretches that hold all terms.

The test set is taken in blocks of at most BLOCK words, so what goes to every task is bounded whatever its size. A term
that stands in every document has a list in each shard, never a list of all documents.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace, table

WINDOW = 10
#: Words of a shard, of a block of the test set, and proposed places that are judged at a time.
SHARD, BLOCK, PLACES = 2_000_000, 500_000, 4_000_000
#: Bytes of words stay, A-Z in lower case; all others are spaces. Bytes from 0x80 on belong to words.
KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
INDEX = "shard long, term binary, n long, places binary, doc_no long, doc_id long, n_words long"
#: The row of a shard without a term holds the places where its documents start.
STARTS = b""
HITS = "shard long, doc_no long, spans array<struct<start:long,length:long>>, items array<string>"
NEAR = "shard long, doc_no long, item string, start long, length long"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(KEEP).split()


def _shard_rows(shard: int, ids: list, texts: list[bytes], sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows of one shard: a row a document, the row of the documents' starts and a row a term. ``texts``: words, each with a space behind it."""
    schema = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("n", pa.int64()), ("places", pa.binary()), ("doc_no", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64())])

    def batch(rows: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([cols.get(f.name, pa.array(np.full(rows, shard)) if f.name == "shard" else pa.nulls(rows, f.type)) for f in schema], schema=schema)

    n_words = np.array(sizes, np.int64)
    starts = np.cumsum(n_words + 1) - n_words - 1
    yield batch(len(ids), doc_no=pa.array(np.arange(len(ids))), doc_id=pa.array(ids, pa.int64()), n_words=pa.array(n_words))
    yield batch(1, term=pa.array([STARTS]), n=pa.array([len(ids)]), places=pa.array([starts.tobytes()]))
    joined = b"".join(texts)
    if not joined:
        return
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) + 1
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
    term, terms = coded.indices.to_numpy(), pc.binary_slice(coded.dictionary.cast(pa.binary()), 0, -1)  # without the space
    order = np.argsort(term, kind="stable")
    doc = np.repeat(np.arange(len(ids)), n_words)
    places = (np.arange(len(term)) + doc)[order]  # a free place before each document but the first
    counts = np.bincount(term, minlength=len(terms))
    edges = np.concatenate([[0], np.cumsum(counts)])
    steps = np.diff(places, prepend=0)  # lists are stored as steps
    steps[edges[:-1]] = places[edges[:-1]]
    step = 65536
    data = steps.astype(np.uint32)
    for i in range(0, len(terms), step):
        at = edges[i : i + step + 1]
        n = len(at) - 1
        blobs = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(((at - at[0]) * 4).astype(np.int32)), pa.py_buffer(data[at[0] : at[-1]].tobytes())])
        yield batch(n, term=terms.slice(i, n), n=pa.array(counts[i : i + step]), places=blobs)


def build_index(docs: DataFrame, shard_words: int = SHARD) -> DataFrame:
    """The rows of the index (INDEX) of ``docs`` (doc_id, text): rows with ``doc_no`` are documents, rows with ``term`` are lists.

    To be written as a table before use. Rows of ``docs`` that share an id, or have none, are documents each by itself; null texts have no
    words. A text of more than ``shard_words`` words ends a shard; its words must be fewer than 2^32."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        ids, texts, sizes, n = [], [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                w = words_of(text.as_py())
                ids.append(doc)
                sizes.append(len(w))
                if w:
                    texts += (b" ".join(w), b" ")
                n += len(w)
                if n >= shard_words:
                    yield from _shard_rows(shard, ids, texts, sizes)
                    ids, texts, sizes, n, shard = [], [], [], 0, shard + 1
        if ids:
            yield from _shard_rows(shard, ids, texts, sizes)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(build, INDEX)


class Phrases:
    """A block of the test set: its different phrases, each with the items that have it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        terms: dict[bytes, int] = {}
        found: dict[tuple[int, ...], dict[int, None]] = {}
        self.names: list[str] = []
        for name, words in items:
            ids = [terms.setdefault(w, len(terms)) for w in words]
            for i in range(max(1, len(ids) - window + 1)) if ids else ():
                found.setdefault(tuple(ids[i : i + window]), {})[len(self.names)] = None
            self.names.append(name)
        self.terms = terms
        self.by_length: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for n in sorted({len(p) for p in found}):
            own = [p for p in found if len(p) == n]
            self.by_length[n] = (np.array(own, np.int64), [list(found[p]) for p in own])


class Shard:
    """The lists of a shard for the terms of a block: keys are term << 40 | place, in ascending order."""

    def __init__(self, pdf: pd.DataFrame, terms: dict[bytes, int]):
        self.starts = np.empty(0, np.int64)
        lists: list[np.ndarray] = [np.empty(0, np.int64)] * len(terms)
        for term, places in zip(pdf["term"], pdf["places"]):
            if bytes(term) == STARTS:
                self.starts = np.frombuffer(places, np.int64)
            elif bytes(term) in terms:
                lists[terms[bytes(term)]] = np.cumsum(np.frombuffer(places, np.uint32), dtype=np.int64)
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.places = np.concatenate(lists) if lists else np.empty(0, np.int64)
        self.keys = (np.repeat(np.arange(len(lists)), self.sizes) << 40) | self.places

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = (term << 40) | np.maximum(place, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[at] == key) & (place >= 0)

    def between(self, term: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether ``term`` has a place in [lo, hi)."""
        at = np.minimum(np.searchsorted(self.keys, (term << 40) | np.maximum(lo, 0)), len(self.keys) - 1)
        found = self.keys[at]
        return (found >= (term << 40) | np.maximum(lo, 0)) & (found < (term << 40) | np.maximum(hi, 0))

    def proposed(self, phrases: np.ndarray, extra: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row of ``phrases``, terms' order from the rarest on, place of the rarest), some at a time; phrases with a term that the shard lacks have none."""
        sizes = self.sizes[phrases]
        order = np.argsort(sizes, axis=1, kind="stable")
        least = np.take_along_axis(sizes, order[:, :1], 1)[:, 0]
        rows = np.flatnonzero(least)
        ends = np.cumsum(least[rows])
        lo = 0
        while lo < len(rows):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PLACES // extra, side="right")))
            own = rows[lo:hi]
            n = least[own]
            row = np.repeat(own, n)
            begin = self.first[phrases[own, order[own, 0]]]
            place = self.places[np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(row))]
            yield row, order, place
            lo = hi

    def exact(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``phrases``, start) of all occurrences."""
        rows, starts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for row, order, place in self.proposed(phrases):
            start = place - order[row, 0]
            for k in range(1, phrases.shape[1]):
                at = order[row, k]
                fits = self.has(phrases[row, at], start + at)
                row, start = row[fits], start[fits]
            rows.append(row), starts.append(start)
        return np.concatenate(rows), np.concatenate(starts)

    def near(self, phrases: np.ndarray, within: int) -> Iterator[tuple[int, int, int, int]]:
        """(row, document, start, length): the shortest stretch of at most ``within`` words of a document, in any order, with all
        words of a phrase (ties: the first one)."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for row, order, place in self.proposed(phrases, 4):
            doc = np.searchsorted(self.starts, place, side="right") - 1
            last = np.concatenate([self.starts[1:] - 1, [np.iinfo(np.int64).max >> 24]])
            lo, hi = np.maximum(place - within + 1, self.starts[doc]), np.minimum(place + within, last[doc])
            for k in range(1, phrases.shape[1]):
                fits = self.between(phrases[row, order[row, k]], lo, hi)
                row, place, doc, lo, hi = row[fits], place[fits], doc[fits], lo[fits], hi[fits]
            for r, d, a, b in zip(row.tolist(), doc.tolist(), lo.tolist(), hi.tolist()):
                lists = []
                for t in set(phrases[r].tolist()):
                    part = self.places[self.first[t] : self.first[t + 1]]
                    lists.append(part[np.searchsorted(part, a) : np.searchsorted(part, b)].tolist())
                for end in sorted(x for part in lists for x in part):
                    froms = [bisect.bisect_right(part, end) for part in lists]
                    if all(froms):
                        start = min(part[i - 1] for part, i in zip(lists, froms))
                        found = (end - start + 1, start - int(self.starts[d]))
                        if found[0] <= within and found < best.get((r, d), (within + 1, 0)):
                            best[r, d] = found
        for (r, d), (n, start) in sorted(best.items()):
            yield r, d, start, n


def _phrase_hits(shard: int, own: Shard, test: Phrases) -> pd.DataFrame:
    """A row (HITS) for each document with an occurrence."""
    docs, items, lo, hi = [], [], [], []
    for n, (phrases, holders) in test.by_length.items():
        row, start = own.exact(phrases)
        if len(row):
            pairs = np.unique(np.stack([row, np.searchsorted(own.starts, start, side="right") - 1]), axis=1)
            for r, d in pairs.T.tolist():
                docs += [d] * len(holders[r])
                items += holders[r]
            lo.append(start), hi.append(start + n)
    if not docs:
        return pd.DataFrame([], columns=["shard", "doc_no", "spans", "items"], dtype=object)
    lo, hi = np.concatenate(lo), np.concatenate(hi)
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > reach[:-1]])  # spans that touch are one
    first = np.flatnonzero(new)
    start, end = lo[first], reach[np.concatenate([first[1:] - 1, [len(lo) - 1]])]
    doc = np.searchsorted(own.starts, start, side="right") - 1
    spans: dict[int, list] = {}
    for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist()):
        spans.setdefault(d, []).append({"start": a - int(own.starts[d]), "length": b - a})
    names: dict[int, set] = {}
    for d, i in zip(docs, items):
        names.setdefault(d, set()).add(test.names[i])
    found = sorted(spans)
    return pd.DataFrame({"shard": shard, "doc_no": found, "spans": [spans[d] for d in found], "items": [sorted(names[d]) for d in found]})


def _near_hits(shard: int, own: Shard, test: Phrases, within: int) -> pd.DataFrame:
    rows = []
    for phrases, holders in test.by_length.values():
        for r, d, start, n in own.near(phrases, within):
            rows += [(shard, d, test.names[i], start, n) for i in holders[r]]
    return pd.DataFrame(rows, columns=["shard", "doc_no", "item", "start", "length"], dtype=None if rows else object)


def _judge(test: Broadcast, within: int | None) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def judge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = Shard(pdf, test.value.terms)
        return _phrase_hits(int(key[0]), own, test.value) if within is None else _near_hits(int(key[0]), own, test.value, within)

    return judge


def blocks(items: DataFrame, most: int = BLOCK) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The test set in blocks of about ``most`` words; longer items make a block each. Items without words are left out."""
    block, n = [], 0
    for name, text in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.col("text").cast("binary")).toLocalIterator():
        words = words_of(bytes(text or b""))
        if words:
            block.append((name, words))
            n += len(words)
        if n >= most:
            yield block
            block, n = [], 0
    if block:
        yield block


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, within: int | None = None, most: int = BLOCK) -> DataFrame | None:
    """Occurrences in ``index`` (a written table of :func:`build_index`) of the phrases of ``items`` (item_id, text): all
    ``window`` consecutive words of an item, or all its words if they are fewer. Exact ones (HITS), a row for each document and block of the test set, with its hit
    spans and the items; or, with ``within``, a row (NEAR) for each document, item and phrase whose words all stand in a stretch
    of at most that many words, with the shortest one. None without any phrase.

    Items that share an id are one item; a null id is named ``null``."""
    spark, out = index.sparkSession, None
    lists = index.where(F.col("term").isNotNull()).select("shard", "term", "places")
    for block in blocks(items, most):
        test = spark.sparkContext.broadcast(Phrases(block, window))
        wanted = spark.createDataFrame([(STARTS,), *[(t,) for t in test.value.terms]], "term binary")
        hits = lists.join(F.broadcast(wanted), "term", "left_semi").groupBy("shard").applyInPandas(_judge(test, within), HITS if within is None else NEAR)
        out = hits if out is None else out.unionByName(hits)
    return out


def contaminated_documents(docs: DataFrame, items: DataFrame, ws: Workspace, window: int = WINDOW, most: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, spans, items) of each row of ``docs``: the stretches of words, numbered from 0, that lie in occurrences
    of the items' phrases, and the ids of the items with occurrences, as sorted strings.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. Null and empty texts have no words; an item without
    words has no phrase; repeated rows, and rows without an id, are judged each; other columns are not read. Without documents there are no rows, without items no spans."""
    index = ws.put("index", build_index(docs))
    hits = search(index, items, window, most=most)
    rows = index.where(F.col("doc_no").isNotNull()).select("shard", "doc_no", "doc_id", "n_words")
    no_spans, no_items = F.expr("cast(array() as array<struct<start:long,length:long>>)"), F.expr("cast(array() as array<string>)")
    if hits is None:
        return rows.select("doc_id", "n_words", no_spans.alias("spans"), no_items.alias("items"))
    hits = ws.put("hits", hits)  # both spans and items come from one search
    # spans of several blocks may overlap: each is cut to what lies behind those before it
    before = Window.partitionBy("shard", "doc_no").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    each = hits.select("shard", "doc_no", F.inline("spans")).withColumn("reach", F.coalesce(F.max(F.col("start") + F.col("length")).over(before), F.lit(0)))
    own = F.struct(F.greatest("start", "reach").alias("start"), (F.col("start") + F.col("length") - F.greatest("start", "reach")).alias("length"))
    spans = each.where("start + length > reach").groupBy("shard", "doc_no").agg(F.array_sort(F.collect_list(own)).alias("spans"))
    names = hits.select("shard", "doc_no", F.explode("items").alias("item")).groupBy("shard", "doc_no").agg(F.array_sort(F.collect_set("item")).alias("items"))
    joined = rows.join(spans.join(names, ["shard", "doc_no"]), ["shard", "doc_no"], "left")
    return joined.select("doc_id", "n_words", F.coalesce("spans", no_spans).alias("spans"), F.coalesce("items", no_items).alias("items"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), Workspace(spark, "op13"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(cast(item_id AS varchar), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
q AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT q.r, q.i, q.n, p.item FROM q JOIN p ON q.n = p.n AND q.phrase = p.phrase),
c AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS place FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
