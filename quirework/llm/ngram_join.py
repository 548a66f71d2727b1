"""N-gram Jaccard self-join by prefix trees.

A document is the set of its word shingles, as 64-bit hashes; equal sets are one class, joined once. Sets are ordered
globally: shingles that few documents have first, by hash, then the frequent ones by document frequency. Two sets that
link share one of their first n - ceil(3n/4) + 1 shingles (at threshold 0.75), where the smaller set needs no more than
its first n - ceil(6n/7) + 1. These prefixes are dealt by shingle. Of the sets that meet at a shingle, the one of least
digest is the pivot; all that meet it anywhere are its family, so any two sets that can link are in one family. Of a
shingle that CROWD sets or more have, the pivot is found by a map-side minimum and joined back, so no group grows with
such a shingle; the others meet in buckets of the hash space.

A family's texts are brought together and its ordered sets are stored in a trie. Each set walks the trie, some shingles
a step: a node's shingles are looked up once for all sets below it, the overlap is carried along, and sets whose missed
shingles exceed what their length allows are left, whole subtrees at once. Sets that links have joined already are
passed over; only links that join two components leave the task, never pairs.

A family of more than BLOCK sets is compared in two rounds. First every set meets the pivot's block. Then, by the
components so far, only the sets outside the family's largest component meet the others, block by block: a family of
near copies is done after the first round, in which each text is sent once or twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import Workspace, table

WORDS, PERCENT = 5, 75
#: A shingle is frequent if so many different sets have it; at most FREQUENT of them (8 MB) are sent to executors. The
#: rest counts as rare: this changes the order of comparison only, no result.
HOT_DF, FREQUENT, CROWD = 24, 1 << 20, 128
#: Digests of sets that a task remembers, so as to deal each once.
SEEN = 200_000
#: Shingles that a set's walk of a trie looks up a step.
STEP = 32
#: Shingles of a shuffle bucket; batches of shingles that a task buckets at once; sets of a family's block; sets that a task's group gets, about.
BUCKET, BATCH, BLOCK, CELL = 1 << 19, 1 << 19, 1024, 512
#: Ids of documents to be compared that are broadcast: at most so many (under 32 MB); beyond it their join is shuffled.
BROADCAST_IDS = 1 << 20
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class WordHashes(dict):
    def __init__(self, most: int = 150_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def shingles(self, text: str | None, n: int = WORDS) -> np.ndarray:
        """The set of the text's word shingles, sorted; A-Z lower-cased, words cut at [\\x20\\x09-\\x0D]."""
        words = text.encode().lower().split() if text else ()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self) > self.most:
            self.clear()
        w = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        k = min(n, len(w))
        h = w[: len(w) - k + 1] * _MULT[0]
        for j in range(1, k):  # words' hashes are random, so a sum with a factor for each place tells shingles apart
            h += w[j : j + len(h)] * _MULT[j % 8] ** np.uint64(j // 8 + 1)
        h = _mix(h + np.uint64(k))
        h.sort()
        first = np.ones(len(h), bool)
        np.not_equal(h[1:], h[:-1], out=first[1:])
        return h[first]


_words = WordHashes()


def digest(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(digest, sorted shingles) of each different set that a task meets anew; empty sets are left out."""
    seen: set[int] = set()
    for b in batches:
        for text in b.column(b.schema.get_field_index("text")):
            tokens = _words.shingles(text.as_py(), n)
            if len(tokens) and (d := digest(tokens)) not in seen:
                if len(seen) > SEEN:
                    seen.clear()  # a set met again later only costs time
                seen.add(d)
                yield d, tokens


def _planes(a: np.ndarray) -> bytes:
    """The numbers' bytes by significance, so that those that are mostly equal lie together and compress."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()


def _unplanes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _bucketed(tokens: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted tokens by bucket: equal ranges of the hash space."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    at = np.concatenate([[0], np.searchsorted(tokens, edges), [len(tokens)]])
    for i in np.flatnonzero(np.diff(at)):
        yield int(i), slice(int(at[i]), int(at[i + 1]))


def text_hash(text: str) -> int:
    """As F.xxhash64 of the text."""
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def read_sets(docs: DataFrame, buckets: int, n: int = WORDS) -> DataFrame:
    """One pass over the texts, with two kinds of rows: doc_id, n_shingles, d (the set's digest, null for an empty set)
    and h (the text's xxhash64) for each document; and bucket, blob, more: 44 bits of the shingles of each different set that
    a task meets, counted by batches of BATCH shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def rows(ids, ns, ds, hs, at, blobs, more) -> pa.RecordBatch:
            fill = lambda x, k, kind: pa.array(x if len(x) else [None] * k, kind)
            k = max(len(ns), len(at))
            kinds = {"doc_id": pa.int64(), "n_shingles": pa.int64(), "d": pa.int64(), "h": pa.int64(), "bucket": pa.int32(), "blob": pa.binary(), "more": pa.binary()}
            return pa.RecordBatch.from_arrays([fill(x, k, kind) for x, kind in zip((ids, ns, ds, hs, at, blobs, more), kinds.values())], names=list(kinds))

        def flush() -> pa.RecordBatch:
            top = np.sort(np.concatenate(held)) >> np.uint64(20)
            first = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
            top, counts = top[first], np.diff(np.append(first, len(top)))
            cut, blobs, more = list(_bucketed(top << np.uint64(20), buckets)), [], []
            for _, s in cut:
                steps, n = np.diff(top[s], prepend=top[s][:1]), counts[s]
                blobs.append(top[s][:1].tobytes() + (b"\0" + _planes(steps.astype(np.uint32)) if steps.max() < 1 << 32 else b"\1" + _planes(steps)))
                at = np.flatnonzero(n > 1)
                more.append(_planes(at.astype(np.uint32)) + _planes(n[at].astype(np.uint32)))
            return rows([], [], [], [], [i for i, _ in cut], blobs, more)

        for b in batches:
            ns, ds, hs = [], [], []
            for text in b.column(1).to_pylist():
                tokens = _words.shingles(text, n)
                hs.append(text_hash(text or ""))
                ns.append(len(tokens))
                ds.append(digest(tokens) if len(tokens) else None)
                if len(tokens) and ds[-1] not in seen:
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(ds[-1])
                    held.append(tokens)
                    size += len(tokens)
                    if size > BATCH:
                        yield flush()
                        held, size = [], 0
            if ns:
                yield rows(b.column(0).to_pylist(), ns, ds, hs, [], [], [])
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, d long, h long, bucket int, blob binary, more binary")


def frequent_shingles(dealt: DataFrame, least: int = HOT_DF, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, ranks, whether CROWD sets or more have it): the ``most`` shingles in most sets, of those in ``least``
    or more, from rows (bucket, blob, more). Shingles that agree in 44 bits of their hash count together, which only
    affects the order."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, numbers = [], []
        for raw, more in zip(pdf["blob"], pdf["more"]):
            steps = _unplanes(raw[9:], np.uint32 if raw[8] == 0 else np.uint64).astype(np.uint64)
            parts.append(np.frombuffer(raw[:8], np.uint64) + np.cumsum(steps, dtype=np.uint64))
            n = np.ones(len(steps), np.int64)
            n[_unplanes(more[: len(more) // 2], np.uint32)] = _unplanes(more[len(more) // 2 :], np.uint32)
            numbers.append(n)
        tokens, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate(numbers)).astype(np.int64)
        keep = counts >= least
        return pd.DataFrame({"t": tokens[keep].astype(np.int64), "df": counts[keep]})

    found = dealt.groupBy("bucket").applyInPandas(count, "t long, df long")
    got = found.orderBy(F.desc("df"), "t").limit(most).toArrow()
    t, df = got.column(0).to_numpy().astype(np.uint64), got.column(1).to_numpy()
    order = np.argsort(t)
    rank = np.empty(len(t), np.int64)
    rank[np.lexsort((t, df))] = np.arange(len(t))
    return t[order], rank[order], (df >= CROWD)[order]


def ordered(tokens: np.ndarray, hot: tuple[np.ndarray, ...]) -> np.ndarray:
    """A sorted set in the global order."""
    if not len(hot[0]):
        return tokens
    top = tokens >> np.uint64(20)
    at = np.minimum(np.searchsorted(hot[0], top), len(hot[0]) - 1)
    is_hot = hot[0][at] == top
    if not is_hot.any():
        return tokens
    late, rank = tokens[is_hot], hot[1][at[is_hot]]
    return np.concatenate([tokens[~is_hot], late[np.argsort(rank, kind="stable")]])


def prefix_lengths(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """(as the larger or the smaller of two sets, as the smaller one): shingles of which a linked pair shares one."""
    return n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1


def least_overlap(a: int, b: int, percent: int = PERCENT) -> int:
    return -(-percent * (a + b) // (100 + percent))


def families(docs: DataFrame, ws: Workspace, hot, buckets: int, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(p, d, m): sets d that share a shingle of their prefixes with others of which p has the least digest, p itself
    too. m is twice the set's size, plus 1 if such a shingle lies in its short prefix."""

    names = ["bucket", "t", "d", "m", "top", "of", "size"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            t, d, m, crowd = (np.concatenate(x) for x in zip(*held))
            if crowd.any():
                k = int(crowd.sum())
                rows = [pa.array((t[crowd] >> np.uint64(20)).astype(np.int64)), pa.array(d[crowd]), pa.array(m[crowd].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int32()), *[pa.nulls(k, pa.binary())] * 3, *rows], names=names)
                t, d, m = t[~crowd], d[~crowd], m[~crowd]
            t = _mix(t)  # prefixes are their sets' low hashes; mixed again (one to one), they fill all buckets alike
            order = np.argsort(t, kind="stable")
            t, d, m = t[order], d[order], m[order]
            cut = list(_bucketed(t, buckets))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in cut], pa.int32()), *[pa.array([_planes(x[s]) for _, s in cut], pa.binary()) for x in (t, d, m)], *[pa.nulls(len(cut), pa.int64())] * 3], names=names)

        shingles, _, crowded = hot.value
        for d, tokens in _sets(batches, n):
            long, short = prefix_lengths(len(tokens), percent)
            t = ordered(tokens, hot.value)[:long]
            m = np.full(len(t), 2 * len(tokens), np.uint32)
            m[:short] += 1
            crowd = np.zeros(len(t), bool)
            if len(shingles):
                at = np.minimum(np.searchsorted(shingles, t >> np.uint64(20)), len(shingles) - 1)
                crowd = crowded[at] & (shingles[at] == t >> np.uint64(20))
            held.append((t, np.full(len(t), d, np.int64), m, crowd))
            size += len(t)
            if size > BATCH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        t, d, m = (np.concatenate([_unplanes(x, kind) for x in pdf[c]]) for c, kind in (("t", np.uint64), ("d", np.int64), ("m", np.uint32)))
        order = np.argsort(t, kind="stable")
        t, d, m = t[order], d[order], m[order]
        same = np.zeros(len(t) + 1, bool)
        same[1:-1] = t[1:] == t[:-1]
        keep = same[1:] | same[:-1]  # shingles that one set has go before the longer sort
        t, d, m = t[keep], d[keep], m[keep]
        order = np.lexsort((d, t))
        t, d, m = t[order], d[order], m[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])  # several tasks may have dealt one set
        t, d, m = t[new], d[new], m[new]
        keep = partnered(t, m.astype(np.int64), percent)
        t, d, m = t[keep], d[keep], m[keep]
        starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, int)
        sizes = np.diff(np.append(starts, len(t)))
        p = np.repeat(d[starts], sizes)  # the first of a run has the least digest
        keep = np.repeat(sizes > 1, sizes)
        p, d, m = p[keep], d[keep], m[keep]
        order = np.lexsort((m, d, p))
        p, d, m = p[order], d[order], m[order]
        last = np.ones(len(p), bool)
        last[:-1] = (p[1:] != p[:-1]) | (d[1:] != d[:-1])
        return pd.DataFrame({"p": p[last], "d": d[last], "m": m[last].astype(np.int64)})

    dealt = ws.put("dealt", docs.select("text").mapInArrow(deal, "bucket int, t binary, d binary, m binary, top long, of long, size long"))
    met = dealt.where("bucket IS NOT NULL").groupBy("bucket").applyInPandas(meet, "p long, d long, m long")
    crowd = dealt.where("bucket IS NULL").select("top", F.col("of").alias("d"), F.col("size").alias("m"))
    # at most FREQUENT rows
    pivots = crowd.groupBy("top").agg(F.min("d").alias("p"), F.max("d").alias("last")).where("p <> last").select("top", "p")
    joined = crowd.join(F.broadcast(pivots), "top").select("p", "d", "m")
    found = ws.put("families", met.unionByName(joined).groupBy("p", "d").agg(F.max("m").alias("m")))
    ws.drop("dealt")
    return found


def partnered(t: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets that meet (equal t, m as in :func:`families`) have one they may link with, by size and prefix."""
    if not len(t):
        return np.zeros(0, bool)
    order = np.lexsort((m, t))
    run, n, short = t[order], m[order] >> 1, (m[order] & 1).astype(bool)
    first = np.ones(len(run), bool)  # of the sets of one size in a run
    first[1:] = (run[1:] != run[:-1]) | (n[1:] != n[:-1])
    starts = np.flatnonzero(first)
    counts = np.diff(np.append(starts, len(run)))
    grun, gn, any_short = run[starts], n[starts], np.logical_or.reduceat(short, starts)
    k = np.arange(len(starts))
    near = np.maximum.accumulate(np.where(any_short, k, -1))  # the last group so far with a short prefix
    below = np.concatenate([[-1], near[:-1]])
    fits = (below >= 0) & (grun[below] == grun) & (100 * gn[below] >= percent * gn)
    above = np.zeros(len(starts), bool)
    above[:-1] = (grun[1:] == grun[:-1]) & (100 * gn[:-1] >= percent * gn[1:])
    group = np.repeat(k, counts)
    ok = fits[group] | (short & above[group]) | ((counts > 1) & any_short)[group]
    out = np.empty(len(t), bool)
    out[order] = ok
    return out


def compatible(m: np.ndarray, other: int, percent: int) -> np.ndarray:
    """Sizes allow a link, and the smaller set has a shared shingle in its short prefix."""
    n, k = m >> 1, other >> 1
    of_small = np.where(n < k, m, np.where(n > k, other, m | other)) & 1
    return (100 * np.minimum(n, k) >= percent * np.maximum(n, k)) & of_small.astype(bool)


class Trie:
    """Ordered sets as a trie: sorted by their sequences, each with the length of the prefix it shares with the one
    before. A node is a shared prefix, a subtree the sets in a row that share it."""

    def __init__(self, sets: list[np.ndarray]):
        self.tokens, flat = np.unique(np.concatenate(sets), return_inverse=True)
        flat, ends = flat.astype(np.int32), np.cumsum([len(x) for x in sets])
        parts = np.split(flat, ends[:-1])
        self.rows = np.array(sorted(range(len(sets)), key=lambda i: parts[i].tobytes()))
        self.flat, self.start, self.size = flat, np.array([ends[i] - len(sets[i]) for i in self.rows]), np.array([len(sets[i]) for i in self.rows])
        self.shared = np.zeros(len(sets), np.int64)
        for i in range(1, len(sets)):
            x, y = parts[self.rows[i - 1]], parts[self.rows[i]]
            n = min(len(x), len(y))
            differ = np.flatnonzero(x[:STEP] != y[:STEP]) if n >= STEP else np.flatnonzero(x[:n] != y[:n])
            if not len(differ) and n > STEP:
                differ = np.flatnonzero(x[:n] != y[:n])
            self.shared[i] = differ[0] if len(differ) else n
        self.mark = np.zeros(len(self.tokens), bool)

    def links(self, probe: np.ndarray, percent: int = PERCENT, want: np.ndarray | None = None) -> list[int]:
        """Rows whose set has the Jaccard similarity with ``probe``, a set in any order; of those in ``want`` only."""
        at = np.searchsorted(self.tokens, probe)
        at = at[self.tokens[np.minimum(at, len(self.tokens) - 1)] == probe]
        self.mark[at] = True
        rows = np.arange(len(self.rows)) if want is None else np.flatnonzero(want[self.rows])
        out: list[int] = []
        depth, missed, shared = 0, np.zeros(len(rows), np.int64), self.shared
        size = self.size[rows]
        room = size + percent * (size + len(probe)) // -(100 + percent)  # a set may miss so many of its shingles
        last = rows
        alive = room >= 0
        while True:
            kept = np.flatnonzero(alive)
            if not len(kept):
                break
            # the prefix that a set shares with the one that is left before it
            if len(kept) < len(alive) or depth == 0:
                where = last[kept] if depth == 0 else kept
                low = np.minimum.reduceat(shared[: where[-1] + 1], where[:-1] + 1) if len(where) > 1 else shared[:0]
                shared = np.concatenate([[0], low])
                rows, size, room, missed = rows[kept], size[kept], room[kept], missed[kept]
            new = shared < depth + STEP
            new[0] = True
            some = np.flatnonzero(new)
            steps = depth + np.arange(STEP)
            inside = steps < size[some][:, None]
            place = np.minimum(self.start[rows[some]][:, None] + steps, len(self.flat) - 1)
            lost = (inside & ~self.mark[self.flat[place]]).sum(1)
            missed = missed + lost[np.cumsum(new) - 1]
            depth += STEP
            alive = missed <= room
            whole = alive & (size <= depth)
            out += self.rows[rows[whole]].tolist()
            alive &= ~whole
        self.mark[at] = False
        return out


def join_block(one: list[np.ndarray], m1: np.ndarray, two: list[np.ndarray], m2: np.ndarray, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join components: (row of ``one``, row of ``two``), or within ``one`` if ``two`` is empty. Sets that
    share a ``label`` (of ``one``, then ``two``) are joined already."""
    trie, out, n = Trie(one), [], len(one)
    root, rows = np.unique(label, return_inverse=True)[1], np.arange(n)
    for j, tokens in enumerate(two or one):
        own, m = (n + j, m2[j]) if two else (j, m1[j])
        want = (root[:n] != root[own]) & compatible(m1, int(m), percent)
        if not two:
            want &= rows < j
        if not want.any():
            continue
        for i in trie.links(tokens, percent, want):
            if root[i] != root[own]:
                out.append((i, j))
                root[root == root[i]] = root[own]
    return out


def _compare_cells(cells: DataFrame, texts: DataFrame, hot, n: int, percent: int) -> DataFrame:
    """(a, b): links that join components, from a written table of cells (p, x, y), each of rows d, m, label and side:
    those of side 1 meet those of side 0, or, where there are none, those of side 0 each other."""
    groups = max(1, -(-cells.count() // CELL))
    given = cells.join(texts.hint("merge"), "d").withColumn("cell", F.pmod(F.xxhash64("p", "x", "y"), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for d, text in zip(pdf["d"], pdf["text"]):
            if d not in held:
                held[d] = ordered(_words.shingles(unpack(text).decode(), n), hot.value)
        order = np.lexsort((pdf["d"], pdf["side"], pdf["y"], pdf["x"], pdf["p"]))
        p, x, y, side, d, m, label = (pdf[c].to_numpy()[order] for c in ("p", "x", "y", "side", "d", "m", "label"))
        cut = np.flatnonzero((p[1:] != p[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        out: list[tuple[int, int]] = []
        for a, b in zip([0, *cut], [*cut, len(p)]):
            mid = a + int(np.searchsorted(side[a:b], 1))
            if mid == a or b - a < 2:
                continue
            one, two = [held[i] for i in d[a:mid]], [held[i] for i in d[mid:b]]
            shift = mid if two else a
            out += [(int(d[a + i]), int(d[shift + j])) for i, j in join_block(one, m[a:mid], two, m[mid:b], label[a:b], percent)]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return given.groupBy("cell").applyInPandas(run, "a long, b long")


def compare(found: DataFrame, texts: DataFrame, ws: Workspace, hot, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b): links of the families ``found`` that join components. ``texts``: d, text. Families of more than BLOCK sets
    take two rounds: all sets with the pivot's block, then those outside the largest component with all others."""
    ints = lambda **cols: [(F.lit(v) if isinstance(v, int) else F.col(v) if isinstance(v, str) else v).cast("int").alias(k) for k, v in cols.items()]
    big = ws.put("big", found.groupBy("p").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > BLOCK).select("p", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks")))
    small = found.join(big, "p", "left_anti").select("p", "d", "m", F.col("d").alias("label"), *ints(x=0, y=0, side=0))
    own = F.when(F.col("d") == F.col("p"), 0).otherwise(F.pmod(F.xxhash64("d"), F.col("blocks")))
    dealt = found.join(big, "p").withColumn("own", own.cast("int"))
    first = dealt.where("own = 0").select("p", "d", "m", F.col("d").alias("label"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"), *ints(x=0, side=0))
    others = dealt.where("own > 0").select("p", "d", "m", F.col("d").alias("label"), *ints(y="own", x=0, side=1))
    cells = ws.put("cells", small.unionByName(first).unionByName(others))
    edges = ws.put("edges", _compare_cells(cells, texts, hot, n, percent))
    ws.drop("cells")
    if big.isEmpty():
        return edges
    labels = components(edges, ws, "rounds")
    labelled = ws.put("labelled", dealt.join(labels, "d", "left").withColumn("label", F.coalesce("label", "d")))
    largest = labelled.groupBy("p", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("p").agg(F.max(F.struct("k", "label")).alias("most"))
    outside = ws.put("outside", labelled.join(largest, "p").where(F.col("label") != F.col("most.label")).select("p", "d"))
    if outside.isEmpty():
        return edges
    parts = ws.put("parts", outside.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")))
    rows = labelled.join(parts, "p").join(outside.withColumn("out", F.lit(True)), ["p", "d"], "left")
    rows = rows.withColumn("part", F.when(F.col("out"), F.pmod(F.xxhash64(F.lit(1), "d"), F.col("parts"))).cast("int"))
    # of two sets outside, the one of the later part meets the other
    met = rows.select("p", "d", "m", "label", F.explode(F.sequence(F.coalesce("part", F.lit(0)), F.col("parts") - 1)).alias("x"), *ints(y="own", side=0))
    comes = rows.where("out").select("p", "d", "m", "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"), *ints(x="part", side=1))
    cells = ws.put("cells2", met.unionByName(comes))
    more = ws.put("edges2", _compare_cells(cells, texts, hot, n, percent))
    return edges.unionByName(more)


def components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(d, label): the least node that edges (a, b) join each node to. Labels pass along edges and then jump to their
    label's label, so a path takes a logarithmic number of rounds; each round is a written table."""
    both = ws.put(f"{name}-edges", edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = ws.put(f"{name}-0", both.groupBy(F.col("a").alias("d")).agg(F.min("b").alias("b")).select("d", F.least("d", "b").alias("label")))
    i = 0
    while True:
        near = both.join(labels.select(F.col("d").alias("b"), "label"), "b").groupBy(F.col("a").alias("d")).agg(F.min("label").alias("near"))
        passed = labels.join(near, "d").select("d", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        passed = ws.put(f"{name}-passed", passed)
        heads = passed.select(F.col("d").alias("label"), F.col("label").alias("head"))
        i += 1
        new = ws.put(f"{name}-{i}", passed.join(heads, "label").select("d", "old", F.col("head").alias("label")))
        if i > 1:
            ws.drop(f"{name}-{i - 2}")
        if new.where("old <> label").isEmpty():
            return new.select("d", "label")
        labels = new.select("d", "label")


def _packed(rows: DataFrame) -> DataFrame:
    """(d, text) with the texts compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack(x) for x in b.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=["d", "text"])

    return rows.select("d", "text").mapInArrow(run, "d long, text binary")


def _judged(docs: DataFrame, ws: Workspace, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, d, h) of each row, and (d, component_id, spot) of each class of equal sets: ``spot`` has the
    doc_id and the text's hash h of a row that stays for the whole component."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-(words // 6) // BUCKET))
    read = ws.put("read", read_sets(plain, buckets, n))
    summary = ws.put("summary", read.where("bucket IS NULL").select("doc_id", "n_shingles", "d", "h"))
    spot = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("i"), "doc_id", "h"))
    classes = ws.put("classes", summary.where("d IS NOT NULL").groupBy("d").agg(F.min("doc_id").alias("first"), spot.alias("spot")))
    hot = docs.sparkSession.sparkContext.broadcast(frequent_shingles(read.where("bucket IS NOT NULL").select("bucket", "blob", "more"), HOT_DF))
    ws.drop("read")
    found = families(plain, ws, hot, buckets, n, percent)
    ids = ws.put("ids", found.select("d").distinct().join(classes, "d").select("d", F.col("spot.doc_id").alias("__id"), F.col("spot.h").alias("__h")))
    few = ids.count() <= BROADCAST_IDS
    # rows that share a doc_id may have other texts, so the text's hash must agree too
    at = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__h"))
    # of rows with one doc_id and text, one text a set
    held = plain.join(F.broadcast(ids) if few else ids, at).dropDuplicates(["d"])
    texts = ws.put("texts", _packed(held))
    edges = compare(found, texts, ws, hot, n, percent)
    labels = components(edges, ws, "labels")
    ws.drop("texts", "families", "ids")
    linked = ws.put("linked", labels.join(classes, "d"))
    least = ws.put("least", linked.groupBy("label").agg(F.min("first").alias("component_id"), F.min("spot").alias("best")))
    known = ws.put("known", linked.join(least, "label").select("d", "component_id", "best"))
    whole = classes.join(known, "d", "left").select("d", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("best", "spot").alias("spot"))
    whole = ws.put("whole", whole)
    ws.drop("linked", "least", "known", "classes")
    return summary, whole


def ngram_components(docs: DataFrame, ws: Workspace, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of ``docs``.

    Documents link when 100 * |intersection| >= percent * |union| of their sets of ``n``-word shingles; component_id is
    the smallest doc_id that links reach. A text of fewer words is one shingle; a null or empty text, or one without
    words, has the empty set and links with nothing. Rows with equal sets are one class. Rows that share a doc_id are
    documents of their own. Rows with a null doc_id keep it, and have the component of the others in their class, null
    if there is none. Texts are read whole; other columns are not read; an empty table gives no rows.

    Two texts count as the same set when 64-bit digests of their sets agree."""
    summary, whole = _judged(docs, ws, n, percent)
    some = summary.where("d IS NOT NULL").join(whole.select("d", "component_id").hint("merge"), "d").select("doc_id", "n_shingles", "component_id")
    none = summary.where("d IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.unionByName(none)


def keep_one(docs: DataFrame, ws: Workspace, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: the one of least doc_id; of rows that share it, the one whose text has
    the least hash, and of these, which have the same text, the one whose columns have the least hash. Rows without
    doc_id, text or words stay all. All columns pass, whatever their names; an empty table gives an empty table."""
    summary, whole = _judged(docs, ws, n, percent)
    judged = summary.where("d IS NOT NULL AND doc_id IS NOT NULL").join(whole.select("d", "spot").hint("merge"), "d")
    stays = (F.col("doc_id") == F.col("spot.doc_id")) & (F.col("h") == F.col("spot.h"))
    counted = ws.put("counted", judged.groupBy("doc_id", "h").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("k")))
    gone, many = ws.put("gone", counted.where("NOT stays").select("doc_id", "h")), ws.put("many", counted.where("stays AND k > 1").select("doc_id", "h"))
    wrap = lambda df: df.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_IDS else df
    left = wrap(docs).join(small(gone), ["doc_id", "h"], "left_anti")
    if not many.isEmpty():
        hashed = [f"row.`{f.name}`" for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        one = left.join(small(many), ["doc_id", "h"], "left_semi").groupBy("doc_id", "h").agg(F.min_by("row", F.xxhash64(*hashed)).alias("row"))
        left = left.join(small(many), ["doc_id", "h"], "left_anti").select("row").unionByName(one.select("row"))
    return left.select("row.*")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), Workspace(spark, "op3"))
