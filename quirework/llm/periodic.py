"""Periodic runs of words by suffix-tree longest common extensions.

A run is a stretch of words with smallest period q and at least max(6, 4 q) words that no neighbouring word extends. Every
run has a Lyndon root: in one of the two orders of the words (one the reverse of the other, the end of the text least in
both), the longest Lyndon word that starts at some place i is one period of the run. So each place proposes two
candidates, (i, next place with a smaller suffix), and each is extended to both sides as far as its period holds: to the
right by the longest common extension of two suffixes in Ukkonen's tree of the text, to the left by the one in the tree
of the reversed text. A common extension is the string depth of the lowest common ancestor of two leaves: the least depth
between them in the Euler tour, which a table over blocks of the tour answers in constant time for all candidates at
once. A candidate whose length is under twice its period is no run; a Lyndon word is primitive, so the period of the
others is the smallest one.

Each word of a run is in it at least four times. Words that a text holds fewer than four times therefore part it into
pieces that no run crosses and no run touches from outside; the same holds within each piece again. Trees are built of
these pieces, so plain prose costs a count of its words. Nothing is shuffled, each document is judged where it lies, and
memory is linear in the longest piece.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import table

#: A run has so many words and so many times its period at least.
MIN_WORDS, MIN_POWER = 6, 4
#: Rounds of parting by rare words, words that are numbered together, and places of a tour in one block of its table.
ROUNDS, CHUNK, BLOCK = 8, 1 << 20, 32
RESULT = "doc_id long, n_words long, n_dropped long, runs array<struct<start:long,length:long,period:long>>, text binary"
DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class RangeMin:
    """Least value between two places of an array in constant time, with memory linear in the array."""

    def __init__(self, values: np.ndarray):
        n = -(-len(values) // BLOCK) * BLOCK
        self.flat = np.concatenate([values, np.full(n - len(values), values[-1], values.dtype)])
        blocks = self.flat.reshape(-1, BLOCK)
        self.head = np.minimum.accumulate(blocks, axis=1).ravel()
        self.tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [blocks.min(axis=1)]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last, np.concatenate([last[step:], np.full(step, last[-1], last.dtype)])))

    def least(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        lo, hi = np.minimum(one, two), np.maximum(one, two)
        out = np.minimum(self.tail[lo], self.head[hi])
        first, count = lo // BLOCK + 1, hi // BLOCK - lo // BLOCK - 1
        far = np.flatnonzero(count > 0)
        level = np.frexp(count[far])[1] - 1
        for k in np.unique(level):
            x, row = far[level == k], self.levels[k]
            out[x] = np.minimum(out[x], np.minimum(row[first[x]], row[first[x] + count[x] - (1 << k)]))
        same = np.flatnonzero(count < 0)
        if len(same):  # both places in one block
            a, b = lo[same], hi[same]
            best = self.flat[a]
            for k in range(1, BLOCK):
                best = np.minimum(best, self.flat[np.minimum(a + k, b)])
            out[same] = best
        return out


class SuffixTree:
    """Ukkonen's suffix tree of ``symbols`` (whole numbers from 1), its Euler tour and the orders of its leaves.

    ``up`` and ``down`` rank the suffixes by the symbols' order and by its reverse; a suffix that is a prefix of another
    comes first in both."""

    def __init__(self, symbols: list[int]):
        text = [*symbols, 0]
        n = self.n = len(text)
        width = max(text) + 1
        start, end, link, suffix, edges = [0], [0], [0], [-1], {}
        node = edge = length = left = 0
        for i, c in enumerate(text):
            left += 1
            last = 0
            while left:
                if not length:
                    edge = i
                key = node * width + text[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(i), end.append(n), link.append(0), suffix.append(i - left + 1)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    at = start[child]
                    span = end[child] - at
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    if text[at + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    fork = len(start)
                    start.append(at), end.append(at + length), link.append(0), suffix.append(-1)
                    start.append(i), end.append(n), link.append(0), suffix.append(i - left + 1)
                    edges[key] = fork
                    edges[fork * width + c] = fork + 1
                    start[child] = at + length
                    edges[fork * width + text[at + length]] = child
                    if last:
                        link[last] = fork
                    last = fork
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1
        self._walk(edges, width, np.array(end) - np.array(start), suffix)

    def _walk(self, edges: dict[int, int], width: int, span: np.ndarray, suffix: list[int]) -> None:
        keys, kids = np.fromiter(edges.keys(), np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges))
        order = np.argsort(keys)
        first = np.searchsorted(keys[order] // width, np.arange(len(suffix) + 1))
        kids, begin, spans = kids[order].tolist(), first.tolist(), span.tolist()
        ends = (keys[order] % width == 0).tolist()  # edges of the end of the text
        at, depth, tour, where, up, down = begin[:], [0] * len(suffix), [0], [0] * self.n, [], []
        path, v = [], 0
        while True:
            p = at[v]
            if p < begin[v + 1]:
                at[v] = p + 1
                child = kids[p]
                s = suffix[child]
                if s < 0:
                    depth[child] = depth[v] + spans[child]
                    tour.append(depth[child])
                    path.append(v)
                    v = child
                    continue
                where[s] = len(tour)
                tour.append(self.n - s)
                tour.append(depth[v])
                if not ends[p]:
                    down.append(s)
                up.append(s)
                continue
            if begin[v] < begin[v + 1] and ends[begin[v]]:
                down.append(suffix[kids[begin[v]]])  # the end of the text as the last of all symbols
            if not path:
                break
            v = path.pop()
            tour.append(depth[v])
        self.where, self.depths = np.array(where), RangeMin(np.array(tour, np.int32))
        self.up, self.down = np.empty(self.n, np.int64), np.empty(self.n, np.int64)
        self.up[up], self.down[down[::-1]] = np.arange(self.n), np.arange(self.n)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes from ``i`` and from ``j`` (other ones) have in common at their start."""
        return self.depths.least(self.where[i], self.where[j])


def next_smaller(ranks: list[int]) -> list[int]:
    """For each place the next one of smaller rank; the last place has the least rank."""
    out, held = [len(ranks)] * len(ranks), []
    for i, r in enumerate(ranks):
        while held and ranks[held[-1]] > r:
            out[held.pop()] = i
        held.append(i)
    return out


def runs_of(symbols: list[int], power: int = MIN_POWER, least: int = MIN_WORDS) -> np.ndarray:
    """(start, length, period) of every run of at least max(``least``, ``power`` times its period) symbols (whole numbers
    from 1), by start, then period. ``power`` is 2 at least."""
    n = len(symbols)
    if n < least:
        return np.empty((0, 3), np.int64)
    tree, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    i = np.tile(np.arange(n), 2)
    j = np.array(next_smaller(tree.up.tolist())[:n] + next_smaller(tree.down.tolist())[:n])
    near = (j - i) * power <= n
    i, j = i[near], j[near]
    right = tree.extension(i, j)
    left = back.extension(n - i, n - j)
    out = np.stack([i - left, j + right - (i - left), j - i], axis=1)
    out = out[out[:, 1] >= np.maximum(least, power * out[:, 2])]
    return np.unique(out[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def pieces(ids: np.ndarray, doc: np.ndarray, power: int = MIN_POWER, least: int = MIN_WORDS) -> Iterator[tuple[int, int]]:
    """Stretches [lo, hi) of ``ids`` (words of documents ``doc``, one after another) that hold every run."""
    at = np.arange(len(ids))
    piece = doc
    for _ in range(ROUNDS):
        _, inverse, counts = np.unique(piece * (int(ids.max(initial=0)) + 1) + ids[at], return_inverse=True, return_counts=True)
        often = counts[inverse] >= power
        whole = bool(often.all())
        at, piece = at[often], piece[often]
        if not len(at):
            return
        new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(piece) != 0)])
        piece = np.cumsum(new) - 1
        enough = np.bincount(piece)[piece] >= least
        at, piece = at[enough], piece[enough]
        if whole or not len(at):
            break
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(piece) != 0, [True]])) if len(at) else []
    for lo, hi in zip(cuts, cuts[1:]):
        yield int(at[lo]), int(at[hi - 1]) + 1


def planted_period(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) where the words from ``a`` on are to repeat with period ``p``: the query's rule, by the id's checksum."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _chunks(b: pa.RecordBatch) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and words of some documents, of about CHUNK words."""
    ids, words, n = [], [], 0
    for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
        ids.append(doc)
        words.append((text.as_py() or b"").split())
        n += len(words[-1])
        if n >= CHUNK:
            yield ids, words
            ids, words, n = [], [], 0
    if ids:
        yield ids, words


def _numbered(words: list[list[bytes]]) -> np.ndarray:
    """A number for each word, the same for equal words."""
    joined = b"".join(b" ".join(w) + b" " for w in words if w)
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) + 1
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    if len(offsets) == 1:
        return np.empty(0, np.int64)
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
    return array.dictionary_encode().indices.to_numpy().astype(np.int64)


def collapse_documents(docs: DataFrame, plant: bool = False) -> DataFrame:
    """(doc_id, n_words, n_dropped, runs, text) of each row: every run by start, then period, and the text whose words stay,
    joined by single spaces. A word goes if some run contains it after that run's first period. ``plant`` makes the
    words of some documents periodic first (:func:`planted_period`).

    Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text has no words, no runs and the empty text; null ids are kept and
    never planted; repeated rows are judged each; other columns are not read; an empty table gives no rows. A text of any
    length is judged whole: time n log n and memory linear in its longest piece."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, words in _chunks(b):
                sizes = np.array([len(w) for w in words], np.int64)
                edges = np.concatenate([[0], np.cumsum(sizes)])
                numbers = _numbered(words)
                for k, doc in enumerate(ids):
                    found = planted_period(doc, len(words[k])) if plant else None
                    if found:
                        a, p = found
                        part = numbers[edges[k] : edges[k + 1]]
                        part[a:] = part[a + np.arange(len(part) - a) % p]
                        words[k] = words[k][:a] + (words[k][a : a + p] * (-(-(len(part) - a) // p)))[: len(part) - a]
                runs: list[list] = [[] for _ in ids]
                for lo, hi in pieces(numbers, np.repeat(np.arange(len(ids)), sizes)):
                    own = np.unique(numbers[lo:hi], return_inverse=True)[1] + 1
                    k = int(np.searchsorted(edges, lo, side="right")) - 1
                    runs[k] += [(lo - int(edges[k]) + s, n, q) for s, n, q in runs_of(own.tolist()).tolist()]
                dropped, texts = [], []
                for w, found in zip(words, runs):
                    marks = np.zeros(len(w) + 1, np.int64)
                    for s, n, q in found:
                        marks[s + q] += 1
                        marks[s + n] -= 1
                    gone = np.cumsum(marks[:-1]) > 0
                    dropped.append(int(gone.sum()))
                    texts.append(b" ".join(x for x, g in zip(w, gone.tolist()) if not g) if found else b" ".join(w))
                lists = [[{"start": s, "length": n, "period": q} for s, n, q in sorted(x, key=lambda r: (r[0], r[2]))] for x in runs]
                run = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                cols = [pa.array(ids, pa.int64()), pa.array(sizes), pa.array(dropped, pa.int64()), pa.array(lists, run), pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_dropped", "runs", "text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(judge, RESULT)


def digest(found: DataFrame) -> DataFrame:
    """The query's columns of :func:`collapse_documents`: the longest run (ties: smallest start, then period) and checksums."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    top = found.select("doc_id", "runs", "text", best.alias("best"), F.array_join(lines, "").alias("lines"))
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(F.expr("best.length * 1000 div -best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(collapse_documents(table(spark, sf_dir, "documents"), plant=True))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) AS h FROM documents),
e AS (SELECT *, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
t AS (SELECT r, n, i, CASE WHEN planted AND i >= a THEN w[1 + a + (i - a) % p] ELSE w[1 + i] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM f)),
s AS (SELECT x.r, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
u AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM s) GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
v AS (SELECT r, start, length, min(q) AS period FROM u GROUP BY r, start, length),
x AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM v),
k AS (SELECT t.r, string_agg(t.word, ' ' ORDER BY t.i) AS kept FROM t ANTI JOIN x ON t.r = x.r AND t.i = x.i GROUP BY t.r),
m AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines, max(struct_pack(l := length, s := -start, p := -period)) AS best FROM v GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -best.s AS start, best.l AS length, -best.p AS period, 1000 * best.l // -best.p AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN m USING (r) LEFT JOIN k USING (r)
"""
