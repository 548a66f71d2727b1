"""Cross-tokenizer alignment with external spill counting of linked token pairs.

Two tokenizers cut the same bytes; the places where tokens of both end cut them into groups, and all tokens of a group are
linked with one another. How many documents hold a pair of ids linked is counted over the corpus in three steps:

1. Where the documents lie, tokens are aligned and a (pair, document) record is made of each pair that a document links.
   About RUN units of text make a run: its records are sorted side-major (by id of the first tokenizer, then of the
   second, then by document), dealt by a radix of the first id into PARTS, and each part is written as zstd frames: its
   pairs with their numbers of documents, and apart from them the documents. A run has no document in common with any other.
2. A task takes one part of all runs, only their pairs. A k-way heap merge adds the numbers of each pair. As pairs come
   side-major, all pairs of an id of the first side are complete when the next id comes: its highest count is known
   and goes back, with the pairs' counts, to each run that holds them, in the run's own order. More than FAN runs are
   first merged into spilled runs of FAN each, and what these are given streams on to the runs that they were merged from.
3. Each run meets its counts again and adds them up by document.

A pair that stands in every document is one entry of each run, whatever the number of documents, so no task sees more of
it than the number of runs. Step 2 holds one frame of each of FAN runs and the pairs of one id; step 3 one run.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import tempfile
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, table

#: Units of a run, parts by first id, runs that are merged at a time, entries of a frame, bytes of blobs that a task holds in memory.
RUN, PARTS, FAN, FRAME, HELD = 1_000_000, 64, 256, 8192, 64 << 20
#: Units and characters whose alignment a worker remembers; units that are looked up, characters that are encoded at a time.
UNITS, CHARS, CHUNK, LEARN = 400_000, 16_000_000, 200_000, 1 << 18
#: White space of the first tokenizer's rule, without the characters that need no care.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
OTHER = WHITE.replace("\n", "").replace(" ", "")
#: White space and the word behind it. A unit starts with a space or line feed after a character that is no white space.
UNIT = f"[{WHITE}]*[^{WHITE}]+(?:[{OTHER}][{WHITE}]*[^{WHITE}]+)*(?:[{OTHER}][{WHITE}]*)?|[{WHITE}]+"
META = "\u2581"
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
RUNS = "run long, part int, pairs binary, docs binary, doc_no long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# -- frames ------------------------------------------------------------------------------------------------------------


def frame(*columns: np.ndarray) -> bytes:
    """A zstd frame of whole-number columns of one length, by planes of their bytes, with its length before it."""
    n = len(columns[0])
    planes = b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(n, 8).T).tobytes() for c in columns)
    data = zstandard.ZstdCompressor(level=1).compress(struct.pack("<I", n) + planes)
    return struct.pack("<I", len(data)) + data


def unframe(data: bytes, columns: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = struct.unpack_from("<I", raw)[0]
    planes = np.frombuffer(raw, np.uint8, offset=4).reshape(columns, 8, n)
    return [np.ascontiguousarray(p.T).view("<u8").ravel().astype(np.int64) for p in planes]


def frames(file, start: int, end: int, columns: int) -> Iterator[list[np.ndarray]]:
    """The frames of a stretch of a file that others read in between."""
    while start < end:
        file.seek(start)
        size = struct.unpack("<I", file.read(4))[0]
        yield unframe(file.read(size), columns)
        start += 4 + size


# -- step 1: alignment and runs -------------------------------------------------------------------------------------------


class Aligner:
    """Tokens, groups and links of units of text, each aligned once.

    Where the tokenizers look across no unit's start, texts are aligned by unit, otherwise whole: the first one must cut by its
    usual rule before merging bytes; the second one must not change its text, and have no piece in which a space or line
    feed follows another character."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        rules, proto = json.loads(self.a.to_str()), model.ModelProto()
        with open(b_path, "rb") as f:
            proto.ParseFromString(f.read())
        pieces, spec = proto.pieces, proto.normalizer_spec
        cut = rules["pre_tokenizer"] or {}
        own_rule = rules["normalizer"] is None and (cut.get("type"), cut.get("use_regex"), cut.get("add_prefix_space")) == ("ByteLevel", True, False)
        plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix and not any(p.type == p.USER_DEFINED for p in pieces)
        self.by_unit = own_rule and plain and not any(re.search(f"[^{WHITE}{META}][{META} \n]", p.piece) for p in pieces)
        spec.add_dummy_prefix = False  # texts come with their space
        self.b = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        # the characters that stand for bytes in the first vocabulary: printable ones for themselves, the others from 256 on
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        entries = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for token, i in entries.items():
            self.a_bytes[i] = bytes(byte[c] for c in token)
        self.b_bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.replace(META, " ").encode() for p in pieces]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.find = re.compile(UNIT if self.by_unit else "(?s:.+)").findall
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.chars = 0
        self.texts: list[bytes] = []
        self.bad: list[bool] = []
        self.counts: list[np.ndarray] = []  # by unit: COUNTS and the number of its pairs
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def learn(self, units: list[str]) -> None:
        some: list[str] = []
        size = 0
        for u in units:
            if u[-1] in WHITE:  # the end of a text: nothing may stand behind it
                self._learn([u])
                continue
            some.append(u)
            size += len(u)
            if size >= LEARN:
                self._learn(some)
                some, size = [], 0
        if some:
            self._learn(some)

    def _learn(self, units: list[str]) -> None:
        joined = "".join(units)
        raw = joined.encode()
        a, b = self.a.encode(joined, add_special_tokens=False).ids, self.b.encode(joined)
        if META in joined or b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            if len(units) > 1:
                self._learn(units[: len(units) // 2])
                self._learn(units[len(units) // 2 :])
                return
            self._add(units, [b""], [True], np.zeros((1, 5), np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
            return
        a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        of_a, of_b = np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends)
        n_a, n_b = np.bincount(of_a, minlength=len(ends)), np.bincount(of_b, minlength=len(ends))
        unit_ends = np.cumsum([len(u.encode()) for u in units])
        unit = np.searchsorted(unit_ends, ends)
        if len(np.intersect1d(unit_ends, ends)) != len(units):
            raise ValueError("a token crosses the start of a unit")
        # all pairs of each group; those of large groups by different ids
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        large = n_a * n_b > 4096
        times = np.where(large, 0, n_b)[of_a]
        at = np.repeat(first_b[of_a] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        pairs, owner = [(np.repeat(a_ids, times) << 32) | b_ids[at]], [np.repeat(unit[of_a], times)]
        weights = [np.ones(len(at), np.int64)]
        for g in np.flatnonzero(large):
            (x, m), (y, n) = (np.unique(ids[f : f + k], return_counts=True) for ids, f, k in ((a_ids, first_a[g], n_a[g]), (b_ids, first_b[g], n_b[g])))
            pairs.append(((x[:, None] << 32) | y).ravel()), weights.append((m[:, None] * n).ravel()), owner.append(np.full(len(x) * len(y), unit[g]))
        pairs, weights, owner = np.concatenate(pairs), np.concatenate(weights), np.concatenate(owner)
        if large.any():
            order = np.argsort(owner, kind="stable")
            pairs, weights, owner = pairs[order], weights[order], owner[order]
        sums = [np.bincount(unit, x, len(units)).astype(np.int64) for x in (n_a, n_b, np.ones(len(ends)), (n_a * n_b).astype(float))]
        a_text, b_text = list(map(str, a)), list(map(str, b))
        groups = [",".join(a_text[i : i + m]) + "|" + ",".join(b_text[j : j + n]) for i, m, j, n in zip(first_a.tolist(), n_a.tolist(), first_b.tolist(), n_b.tolist())]
        edges = [0, *(np.searchsorted(ends, unit_ends) + 1).tolist()]
        texts = [";".join(groups[i:j]).encode() for i, j in zip(edges, edges[1:])]
        self._add(units, texts, [False] * len(units), np.stack([*sums, np.bincount(owner, minlength=len(units))], axis=1), pairs, weights)

    def _add(self, units: list[str], texts: list[bytes], bad: list[bool], counts: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> None:
        for u in units:
            self.ids[u] = len(self.ids)
            self.chars += len(u)
        self.texts += texts
        self.bad += bad
        self.counts.append(counts), self.pairs.append(pairs), self.times.append(times)

    def known(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(counts by unit, pairs and their times, unit after unit)."""
        self.counts, self.pairs, self.times = ([np.concatenate(x)] if x else [e] for x, e in ((self.counts, np.zeros((0, 5), np.int64)), (self.pairs, np.empty(0, np.int64)), (self.times, np.empty(0, np.int64))))
        return self.counts[0], self.pairs[0], self.times[0]

    def units(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Numbers of the units of all texts, each text with a space before it, and where each text's units end."""
        found, ends = [], []
        for t in texts:
            if t:
                found += self.find(" " + t)
            ends.append(len(found))
        self.learn(list(set(found).difference(self.ids)))
        return list(map(self.ids.__getitem__, found)), ends


class Run:
    """Documents that make a run: their rows, and their units' numbers."""

    def __init__(self):
        self.doc_ids: list = []
        self.rows: list[np.ndarray] = []
        self.hashes: list[str] = []
        self.doc: list[np.ndarray] = []
        self.unit: list[np.ndarray] = []
        self.size = 0

    def add(self, aligner: Aligner, ids: list, texts: list[str]) -> None:
        numbers, ends = aligner.units(texts)
        first = len(self.doc_ids)
        n = np.diff(ends, prepend=0)
        doc, unit = np.repeat(np.arange(len(ids)), n), np.array(numbers, np.int64)
        bad = np.zeros(len(ids), bool)
        bad[doc[np.array(aligner.bad, bool)[unit]]] = True
        good = ~bad[doc]
        counts = aligner.known()[0]
        rows = np.zeros((len(ids), 4), np.int64)
        np.add.at(rows, doc[good], counts[unit[good], :4])
        at = 0
        for end, wrong in zip(ends, bad.tolist()):
            own = b"" if wrong or at == end else b";".join(map(aligner.texts.__getitem__, numbers[at:end]))
            self.hashes.append(hashlib.sha256(own).hexdigest() if own else "")
            at = end
        self.doc_ids += ids
        self.rows.append(rows), self.doc.append(doc[good] + first), self.unit.append(unit[good])
        self.size += len(unit)

    def records(self, aligner: Aligner, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
        """(part, pairs, documents) of the run, sorted side-major."""
        doc, unit = np.concatenate(self.doc), np.concatenate(self.unit)
        if not len(doc):
            return
        counts, pairs, times = aligner.known()
        n_docs, size = len(self.doc_ids), counts[:, 4]
        first = np.cumsum(size) - size
        key, often = np.unique(doc * len(size) + unit, return_counts=True)
        doc, unit = key // len(size), key % len(size)
        n = size[unit]
        at = np.repeat(first[unit] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        different, rank = np.unique(pairs, return_inverse=True)
        part = ((different >> 32) * 0x9E3779B1 >> 12) % parts
        order = np.argsort(part, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        record = place[rank[at]] * n_docs + np.repeat(doc, n)
        weight = times[at] * np.repeat(often, n)
        by = np.argsort(record, kind="stable")
        record, weight = record[by], weight[by]
        edge = np.flatnonzero(np.concatenate([[True], record[1:] != record[:-1]]))
        record, weight = record[edge], np.add.reduceat(weight, edge)
        entry, doc = order[record // n_docs], record % n_docs
        edge = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
        entry, n = entry[edge], np.diff(np.append(edge, len(record)))
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(part[entry]) != 0, [True]]))
        edge = np.append(edge, len(record))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            blob = b"".join(frame(np.diff(different[entry[k : min(j, k + FRAME)]], prepend=0), n[k : min(j, k + FRAME)]) for k in range(i, j, FRAME))
            own = slice(edge[i], edge[j])
            step = np.diff(doc[own], prepend=0)
            yield int(part[entry[i]]), blob, frame(n[i:j]) + frame((step << 1) ^ (step >> 63), weight[own])


_held: dict[tuple[str, str], Aligner] = {}


def write_runs(docs: DataFrame, a_path: str, b_path: str, run_units: int = RUN, parts: int = PARTS) -> DataFrame:
    """Step 1 (RUNS): rows with ``doc_no`` are documents, rows with ``part`` are a part of a run."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RUNS.split(", ")])

    def batch(rows: int, **cols: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(rows, f.type)) for f in schema], schema=schema)

    def out(number: int, run: Run, aligner: Aligner) -> Iterator[pa.RecordBatch]:
        n, rows = len(run.doc_ids), np.concatenate(run.rows)
        ids = pa.array(np.full(n, number))
        yield batch(n, run=ids, doc_no=pa.array(np.arange(n)), doc_id=pa.array(run.doc_ids, pa.int64()), groups_sha256=pa.array(run.hashes), **{c: pa.array(rows[:, i]) for i, c in enumerate(COUNTS)})
        for part, pairs, held in run.records(aligner, parts):
            yield batch(1, run=pa.array([number]), part=pa.array([part], pa.int32()), pairs=pa.array([pairs]), docs=pa.array([held]))
        if len(aligner.ids) > UNITS or aligner.chars > CHARS:
            aligner.forget()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _held.get((a_path, b_path)) or _held.setdefault((a_path, b_path), Aligner(a_path, b_path))
        number, run = TaskContext.get().partitionId() << 32, Run()
        for b in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(doc)
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= 6 * min(CHUNK, run_units):
                    run.add(aligner, ids, texts)
                    ids, texts, size = [], [], 0
                if run.size >= run_units:
                    yield from out(number, run, aligner)
                    number, run = number + 1, Run()
            if ids:
                run.add(aligner, ids, texts)
        if run.doc_ids:
            yield from out(number, run, aligner)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(align, RUNS)


# -- step 2: heap merge ---------------------------------------------------------------------------------------------------


class Pairs:
    """A sorted run of (pair, number of documents) in a stretch of a file, and the values that are given to its pairs."""

    def __init__(self, file, start: int, end: int):
        self.file, self.start, self.end = file, start, end
        self.given, self.out = array("q"), []

    def entries(self, k: int) -> Iterator[tuple[int, int, int]]:
        for steps, n in frames(self.file, self.start, self.end, 2):
            for pair, count in zip(np.cumsum(steps).tolist(), n.tolist()):
                yield pair, k, count

    def take(self, value: int) -> None:
        self.given.append(value)
        if len(self.given) == FRAME:
            self.flush()

    def flush(self) -> None:
        if self.given:
            self.out.append(frame(np.array(self.given, np.int64)))
            self.given = array("q")


class Spilled(Pairs):
    """The merge of several runs, in a file of its own that goes with the task; so is what its pairs are given."""

    def __init__(self, merged: Iterable[tuple[int, list[int], int]]):
        super().__init__(tempfile.TemporaryFile(), 0, 0)
        self.values_file = tempfile.TemporaryFile()
        pairs, counts = array("q"), array("q")
        for pair, _, n in merged:
            pairs.append(pair), counts.append(n)
            if len(pairs) == FRAME:
                self.file.write(frame(np.diff(np.array(pairs, np.int64), prepend=0), np.array(counts, np.int64)))
                pairs, counts = array("q"), array("q")
        if pairs:
            self.file.write(frame(np.diff(np.array(pairs, np.int64), prepend=0), np.array(counts, np.int64)))
        self.end = self.file.tell()

    def flush(self) -> None:
        super().flush()
        self.values_file.seek(0, 2)
        self.values_file.write(b"".join(self.out))
        self.out = []

    def values(self) -> Iterator[int]:
        self.flush()
        for (v,) in frames(self.values_file, 0, self.values_file.seek(0, 2), 1):
            yield from v.tolist()

    def close(self) -> None:
        self.file.close(), self.values_file.close()


def merged(runs: list[Pairs]) -> Iterator[tuple[int, list[int], int]]:
    """(pair, runs that hold it, documents that hold it) by a heap of the runs' next pairs."""
    last, holders, total = -1, [], 0
    for pair, k, n in heapq.merge(*(r.entries(k) for k, r in enumerate(runs))):
        if pair != last:
            if holders:
                yield last, holders, total
            last, holders, total = pair, [], 0
        holders.append(k)
        total += n
    if holders:
        yield last, holders, total


def with_maxima(pairs: Iterable[tuple[int, list[int], int]]) -> Iterator[tuple[list[int], int]]:
    """(runs, 2 * count + whether it is the highest of the pair's first id): the pairs of one first id are held."""
    side, held, top = -1, [], 0
    for pair, holders, n in pairs:
        if pair >> 32 != side:
            yield from ((h, 2 * c + (c == top)) for h, c in held)
            side, held, top = pair >> 32, [], 0
        held.append((holders, n))
        top = max(top, n)
    yield from ((h, 2 * c + (c == top)) for h, c in held)


def settle(runs: list[Pairs], values: Iterator[int] | None = None, fan: int = FAN) -> None:
    """Gives each run, in its own order, the value of each of its pairs: ``values``, or those of all runs together."""
    if len(runs) > fan:
        groups = [runs[i : i + fan] for i in range(0, len(runs), fan)]
        spilled = [Spilled(merged(g)) for g in groups]
        settle(spilled, values, fan)
        for g, s in zip(groups, spilled):
            settle(g, s.values(), fan)
            s.close()
        return
    for holders, value in with_maxima(merged(runs)) if values is None else ((h, v) for (_, h, _), v in zip(merged(runs), values)):
        for k in holders:
            runs[k].take(value)
    for r in runs:
        r.flush()


def count_pairs(runs: DataFrame, parts: int = PARTS, fan: int = FAN) -> DataFrame:
    """Step 2: (run, part, counts) for each part of a run."""

    def settled(part: int, file, at: list[tuple[int, int, int]]) -> pa.RecordBatch:
        own = [Pairs(file, start, end) for _, start, end in at]
        settle(own, fan=fan)
        cols = [pa.array([r for r, _, _ in at], pa.int64()), pa.array([part] * len(at), pa.int32()), pa.array([b"".join(p.out) for p in own])]
        file.close()
        return pa.RecordBatch.from_arrays(cols, names=["run", "part", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file, at = None, None, []
        for b in batches:
            for run, part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if part != now:
                    if at:
                        yield settled(now, file, at)
                    now, file, at = part, tempfile.SpooledTemporaryFile(max_size=HELD), []
                start = file.seek(0, 2)
                file.write(blob.as_py())
                at.append((run, start, file.tell()))
        if at:
            yield settled(now, file, at)

    own = runs.where(F.col("part").isNotNull()).select("run", "part", "pairs")
    return own.repartition(parts, "part").sortWithinPartitions("part", "run").mapInArrow(count, "run long, part int, counts binary")


# -- step 3: contributions ------------------------------------------------------------------------------------------------


def _added(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of a run with what their links' counts add up to."""
    docs = left.filter(pa.compute.is_valid(left["doc_no"])).sort_by("doc_no")
    best, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    counts = {p: c for p, c in zip(right["part"].to_pylist(), right["counts"])}
    for part, held in zip(left["part"].to_pylist(), left["docs"]):
        if part is None:
            continue
        blob = held.as_py()
        size = struct.unpack_from("<I", blob)[0]
        (n,), (step, weight) = unframe(blob[4 : 4 + size], 1), unframe(blob[8 + size :], 2)
        doc = np.cumsum((step >> 1) ^ -(step & 1))
        data, at, values = counts[part].as_py(), 0, []
        while at < len(data):
            size = struct.unpack_from("<I", data, at)[0]
            values.append(unframe(data[at + 4 : at + 4 + size], 1)[0])
            at += 4 + size
        value = np.repeat(np.concatenate(values), n)
        np.add.at(best, doc, weight * (value & 1))
        np.add.at(total, doc, weight * (value >> 1))
    return pa.table([docs["doc_id"], *[docs[c] for c in COUNTS], pa.array(best), pa.array(total), docs["groups_sha256"]], names=[c.split()[0] for c in RESULT.split(", ")])


def align_documents(docs: DataFrame, ws: Workspace, a_path: str | None = None, b_path: str | None = None, run_units: int = RUN, parts: int = PARTS, fan: int = FAN) -> DataFrame:
    """(RESULT) of each row of ``docs`` (doc_id, text): tokens of both tokenizers, groups, links, links whose pair's count
    is the highest of its first id, the sum of all links' counts, and a hash of the groups.

    A pair's count is the number of rows that hold it linked: rows that share a doc_id, or have none, are documents each by
    itself. A null or empty text, and one that a tokenizer's tokens do not give back byte by byte, has no tokens: zeros and ''.
    Texts of any length are aligned whole; a document ends in the run it starts in. Other columns are not read; an empty
    table gives no rows. The tokenizers' files must lie at the same paths on all executors."""
    a, b = default_tokenizers()
    runs = ws.put("runs", write_runs(docs, a_path or a, b_path or b, run_units, parts))
    counts = count_pairs(runs, parts, fan)
    return runs.drop("pairs").groupBy("run").cogroup(counts.groupBy("run")).applyInArrow(_added, RESULT)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"), Workspace(spark, "op12"))
