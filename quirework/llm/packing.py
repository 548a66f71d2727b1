"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

Documents are tokenized where they lie, cut at every multiple of the sequence length, and only the pieces' lengths are
moved: documents are dealt at random into groups of about ``GROUP`` pieces and packed group by group. In a group, pieces go in
descending length to the first bin that still has room; the tree holds the largest room below each node, so that bin is
found in log2(bins) steps. Groups are independent: a lost one is packed again alone, and memory is bounded by a group.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, table

LENGTH, END_ID, GROUP = 2048, 1, 4096
#: Words that are looked up at a time, and bytes of texts whose words are told apart at a time.
CHUNK, SLICE = 1 << 16, 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: What the tokenizer's byte-level step turns the bytes of letters beyond ASCII into, read as Latin-1.
BYTES = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
#: Marks that the tokenizer cuts off from letters before them, and from which it takes no ending: those of ASCII but '.
STOPS = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum() and c != 39)
#: Letters that the tokenizer's normaliser turns into one letter, whatever stands beside them: Latin ones, by rule.
PLAIN = frozenset(c for c in map(chr, range(65, 0x250)) if c.isalpha() and is_normalized("NFC", c) and len(c.lower()) == 1 and c.lower().isalpha())
#: The rules of a tokenizer by which words, and letters and the marks behind them, have ids of their own.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Word -> the bytes of its ids. A tokenizer of the rules above drops white space and never looks across it, so a
    text's ids are its words' ids one after another; nor does it look from plain letters to ASCII marks behind them, or
    at the case of plain letters. Words with other characters are encoded whole; by a tokenizer of other rules, texts
    are. Texts are looked up by slices: each different word of a slice once. About ``most`` words are held in two halves:
    when the newer one is full, the older one goes, but for the words met since. Long words are not held."""

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.older = Tokenizer.from_file(path), most, {}
        self.model = self.tokenizer.model
        rules = json.loads(self.tokenizer.to_str())
        inner = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
        own = rules["model"].get("end_of_word_suffix") == "</w>" and inner[1:] == [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        # an added token with white space, or one found in letters and marks, would be found across words
        added = all(not set(x["content"]) & set(" \t\n\r\v\f") and not x["lstrip"] and not x["rstrip"] and any(c.isdigit() or c == "|" for c in x["content"]) for x in rules["added_tokens"])
        self.by_word = rules["normalizer"] == NORMALISER and inner[0] == SPLIT and own and added

    def parts(self, word: bytes) -> tuple[str, bytes]:
        """(letters in lower case, marks behind them), or no letters where the word is not of this form."""
        core = word.rstrip(STOPS)
        if core.isalpha():  # of ASCII
            return core.decode().lower(), word[len(core) :]
        text = core.decode()
        if text and PLAIN.issuperset(text):
            return text.lower(), word[len(core) :]
        return "", word

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            low, tail = self.parts(word)
            if not low:
                ids = self.encode(word.decode())
            elif tail or low.encode() != word:
                ids = self[low.encode()] + (self[tail] if tail else b"")
            else:  # the tokenizer's other steps leave plain letters in lower case as they are
                letters = low if word.isascii() else word.decode("latin-1").translate(BYTES)
                ids = array("I", [x.id for x in self.model.tokenize(letters)]).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def encode(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def of(self, text: str) -> bytes:
        return b"".join(self.of_all(pa.array([text], pa.string())))

    def of_all(self, texts: pa.Array) -> Iterator[bytes | memoryview]:
        """The bytes of the ids of each text; null has none. Arrow's free memory is given back after each slice."""
        if not self.by_word:
            yield from (self.encode(x.as_py() or "") for x in texts)
            return
        sizes = pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64)
        windows = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // SLICE)) + 1
        long = np.flatnonzero(sizes > SLICE)  # each by itself
        bounds = sorted({0, len(texts), *windows.tolist(), *long.tolist(), *(long + 1).tolist()})
        for a, b in zip(bounds, bounds[1:]):
            if sizes[a] > SLICE:
                yield b"".join(ids for part in stretches(texts[a].as_py().encode()) for ids in self.looked_up(pa.array([part], pa.binary()).cast(pa.string())))
            else:
                yield from self.looked_up(texts.slice(a, b - a))
            pa.default_memory_pool().release_unused()

    def rest(self) -> None:
        """Between tasks, whose workers may go on with other work: the older half goes, and Arrow's free memory."""
        self.older = {}
        pa.default_memory_pool().release_unused()

    def looked_up(self, texts: pa.Array) -> Iterator[memoryview]:
        """Looks each different word of all ``texts`` up once."""
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        different, found = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), []
        for i in range(0, len(different), CHUNK):
            if len(self) > self.most // 2:
                self.older = dict(self)
                self.clear()
            found += map(self.__getitem__, different[i : i + CHUNK])
        ids = pa.array(found, pa.large_binary()).take(words.indices)
        _, starts, data = ids.buffers()
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        ends = np.frombuffer(starts, np.int64)[at].tolist() if len(ids) else [0] * len(at)
        view = memoryview(data or b"")
        for a, b in zip(ends, ends[1:]):
            yield view[a:b]


def stretches(text: bytes) -> Iterator[bytes]:
    """``text`` cut behind white space, each stretch of ``SLICE`` bytes and the rest of a word."""
    at = 0
    while at < len(text):
        space = SPACE.search(text, at + SLICE)
        end = space.end() if space else len(text)
        yield text[at:end]
        at = end


_held: dict[str, WordIds] = {}


def cut_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, seed: int = 0) -> DataFrame:
    """A row for each piece of each document (:data:`PIECES`), and ``deal``, a random number of the document's row."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _held.get(tokenizer) or _held.setdefault(tokenizer, WordIds(tokenizer))
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc, found, deal in zip(b.column(0).to_pylist(), words.of_all(b.column(1)), b.column(2).to_pylist()):
                ids = b"".join((found, end))
                n, view = len(ids) // 4, memoryview(ids)
                for start in range(0, n, length):
                    part = view[4 * start : 4 * (start + length)]
                    for c, v in zip(cols, (doc, start, len(part) // 4, zlib.crc32(part), n, deal)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"])
        b = found = None
        words.rest()

    deal = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    return docs.select(F.col("doc_id").cast("long"), "text", deal.alias("deal")).mapInArrow(cut, PIECES + ", deal long")


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; equal lengths go in the order given. No length may exceed ``capacity``."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    leaves = 1
    while leaves < max(n, 1):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            best = room[2 * node] if room[2 * node] >= room[2 * node + 1] else room[2 * node + 1]
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def pack(pieces: DataFrame, n_pieces: int, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``pieces`` (a written table of :func:`cut_documents`) with the sequence each lies in and its offset there.
    sequence_id is group * 2**32 + bin: unique, not consecutive."""
    groups = max(1, -(-n_pieces // group))
    dealt = pieces.withColumn("grp", F.pmod("deal", F.lit(groups)))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "deal"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), length)
        return pdf.assign(sequence_id=pdf["grp"].to_numpy() * 2**32 + bins, offset=offsets).drop(columns=["grp", "deal"])

    return dealt.groupBy("grp").applyInPandas(fit, PACKED)


def pack_documents(docs: DataFrame, ws: Workspace, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """Every piece of ``docs`` with its place (:data:`PACKED`). Null and empty texts are the end id alone. Rows that
    share a doc_id, or have none, are packed each by itself, and identical rows are dealt apart. A text of any length is cut; none is dropped. An empty
    table gives no rows; other columns are not read."""
    pieces = ws.put("pieces", cut_documents(docs, tokenizer or default_tokenizer(), length))
    return pack(pieces, pieces.count(), length)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), Workspace(spark, "op8"))
