"""N-best segmentation into SentencePiece pieces, and decoding.

A text's lattice has a node between any two characters and an edge for each piece of the vocabulary that fits there. No
piece crosses from a character to a following space mark, and none but its own crosses a line feed: every path visits
the nodes there, so the lattice is a chain of one lattice for each word. On a lattice, Viterbi runs forward and leaves
each node the best score of a path to it. An A* search then runs backward from the end with these scores as its
heuristic; they are exact, so it completes paths in the order of their scores.

A path of the text is a path through each word's lattice, and its score is the sum of theirs. Call the loss of a word's
path what it scores below the word's best one, and a word's loss that of its second-best path. A path that takes another
than the best one in a word outside the n - 1 words of least loss loses at least what each of the n - 1 paths loses that
take the second-best one in one of these words only; with the best path these are n that score no less. So the n best
paths are found among those that differ from the best one in these n - 1 words. The forward pass leaves each word's
loss, A* runs for these words only, and a heap over their alternatives yields the sums in order.

Scores are those of the model file, rounded to 2**-24 (which changes no score of 1 or more in size) and added up in
doubles, so sums are exact up to 2**29. In a unigram model they are log-probabilities, and the result is what the
library's own n-best search finds. In a byte-pair model a piece's score is the negated rank of the merge that makes it:
the library applies merges one by one and doesn't maximise any sum, so its own encoding is rarely the best path here
(of the 200 documents of the smallest test table, never); the n best paths of the lattice are what this operator returns.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import table

N = 3
SPACE, BARE, GAP = "▁", "\x01", "\x00"
#: What an unknown character costs beyond the worst piece.
UNKNOWN = 10
NEVER = -math.inf
UNIT = 1 << 24
#: Words that a worker holds (about 180 bytes each), words looked up at a time, ids of an output batch, about.
HELD, CHUNK, BATCH = 300_000, 1 << 16, 1 << 20
#: Longer words are segmented one by one and not held.
LONG = 40
RESULT = "doc_id long, rank int, score double, n_ids int, ids_crc32 long, ids array<int>"
DECODED = ", text_crc32 long, round_trip boolean"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Trie:
    """The vocabulary as a trie that all positions of a text walk together, a character a step."""

    def __init__(self, pieces: dict[str, int]):
        nodes, level, self.levels, self.piece = {"": 0}, [""], [], [-1]
        by_length = sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)}, key=lambda p: (len(p), p))
        for p in by_length:
            nodes[p] = len(nodes)
            self.piece.append(pieces.get(p, -1))
        for size in range(1, len(by_length[-1]) + 1 if by_length else 1):
            level = [p for p in by_length if len(p) == size]
            keys = np.array([nodes[p[:-1]] << 21 | ord(p[-1]) for p in level], np.int64)
            order = np.argsort(keys)
            self.levels.append((keys[order], np.array([nodes[p] for p in level], np.int64)[order]))
        self.piece = np.array(self.piece)

    def walk(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, piece) of every place where a piece fits, the longer ones first."""
        codes, found = np.append(codes, 0).astype(np.int64), []
        at, node = np.arange(len(codes) - 1), np.zeros(len(codes) - 1, np.int64)
        for size, (keys, child) in enumerate(self.levels, 1):
            key = node << 21 | codes[at + size - 1]
            near = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            ok = np.flatnonzero(keys[near] == key)
            at, node = at[ok], child[near[ok]]
            if not len(at):
                break
            piece = self.piece[node]
            hit = np.flatnonzero(piece >= 0)
            found.append((at[hit], at[hit] + size, piece[hit]))
        return tuple(np.concatenate(x) for x in zip(*found[::-1])) if found else (np.zeros(0, np.int64),) * 3


class Pieces:
    """The vocabulary of a model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalise, self.size = sp.normalize, sp.vocab_size()
        self.text, self.bytes_, normal = {}, {}, []
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_[int(piece[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal.append((piece, i, round(sp.get_score(i) * UNIT) / UNIT))
            self.text[i] = piece
        self.byte_of = {i: b for b, i in self.bytes_.items()}
        self.control = {i for i in range(self.size) if sp.is_control(i) or sp.is_unknown(i)}
        utf8 = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.control else self.text[i].encode() for i in range(self.size)]
        self.utf8, self.utf8_size = np.frombuffer(b"".join(utf8), np.uint8), np.array([len(x) for x in utf8], np.int64)
        self.utf8_start = np.cumsum(self.utf8_size) - self.utf8_size
        self.unknown_id = sp.unk_id()
        self.edges = ahocorasick.Automaton()
        for piece, i, score in normal:
            if any(a != SPACE and b == SPACE for a, b in zip(piece, piece[1:])) or ("\n" in piece and len(piece) > 1):
                raise ValueError(f"piece {piece!r} crosses words")
            if GAP in piece:
                raise ValueError(f"piece {piece!r} has the character that stands between words here")
            self.edges.add_word(piece, (i, len(piece), score))
        self.edges.make_automaton()
        self.scores = np.zeros(self.size)
        self.scores[[i for _, i, _ in normal]] = [s for _, _, s in normal]
        self.trie = Trie({p: i for p, i, _ in normal})
        self.singles = frozenset(p for p, _, _ in normal if len(p) == 1)
        self.single_codes = np.array(sorted(map(ord, self.singles)), np.uint32)
        self.unknown = min(s for _, _, s in normal) - UNKNOWN

    def expand(self, char: str) -> list[int]:
        """An unknown character as byte pieces, where the model has them."""
        return [self.bytes_[b] for b in char.encode()] if self.bytes_ else [self.unknown_id]

    def lattice(self, word: str) -> list[list[tuple[int, float, int]]]:
        """Edges (begin, score, id) by the node they end in; id -1 is an unknown character."""
        ends: list[list[tuple[int, float, int]]] = [[] for _ in range(len(word) + 1)]
        for last, (i, n, score) in self.edges.iter(word):
            ends[last + 1].append((last + 1 - n, score, i))
        for k, c in enumerate(word):
            if c not in self.singles:
                ends[k + 1].append((k, self.unknown, -1))
        return ends

    def ids(self, word: str, path: list[tuple[int, int]]) -> list[int]:
        """``path``: (begin, id) from the front."""
        out: list[int] = []
        for begin, i in path:
            out += [i] if i >= 0 else self.expand(word[begin])
        return out


def forward(ends: list[list[tuple[int, float, int]]]) -> tuple[list[float], list[float], list[tuple[int, int]]]:
    """(best, second, into): by node, the scores of the two best paths from the front, and the best one's last edge."""
    n = len(ends)
    best, second, into = [NEVER] * n, [NEVER] * n, [(0, -1)] * n
    best[0] = 0.0
    for k in range(1, n):
        b1 = b2 = NEVER
        edge = (0, -1)
        for begin, score, i in ends[k]:
            s = best[begin] + score
            if s > b1:
                b2, b1, edge = b1, s, (begin, i)
            elif s > b2:
                b2 = s
            s = second[begin] + score
            if s > b2:
                b2 = s
        best[k], second[k], into[k] = b1, b2, edge
    return best, second, into


def forward_all(pieces: Pieces, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`forward` over the lattices of many words at once, node by node from the front: (score, loss of the second-best
    path, ids of the best paths one after another, ids of each word). All characters must be pieces."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1  # a word's first node; its last one is where the gap stands
    begin, end, piece = pieces.trie.walk(np.frombuffer(GAP.join(words).encode("utf-32-le"), np.uint32))
    gain = pieces.scores[piece]
    nth = end - np.repeat(starts, sizes + 1)[end]
    order = np.argsort(nth * (len(words) * (LONG + 1) + 1) + end, kind="stable")
    end, piece, begin, gain, nth = end[order], piece[order], begin[order], gain[order], nth[order]
    new = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))  # the first edge into each node
    node, many = end[new], np.diff(np.append(new, len(end)))
    cuts = np.searchsorted(nth[new], np.arange(1, int(sizes.max()) + 2))
    best, second = np.full(starts[-1] + sizes[-1] + 1, NEVER), np.full(starts[-1] + sizes[-1] + 1, NEVER)
    into = np.zeros(len(best), np.int64)
    best[starts] = 0
    for lo, hi in zip(cuts, cuts[1:]):
        a, b = new[lo], new[hi] if hi < len(new) else len(end)
        at, group = new[lo:hi] - a, np.repeat(np.arange(hi - lo), many[lo:hi])
        one, two = best[begin[a:b]] + gain[a:b], second[begin[a:b]] + gain[a:b]
        top = np.maximum.reduceat(one, at)
        first = np.minimum.reduceat(np.where(one == top[group], np.arange(b - a), b - a), at)
        one[first] = NEVER
        best[node[lo:hi]], into[node[lo:hi]] = top, first + a
        second[node[lo:hi]] = np.maximum(np.maximum.reduceat(one, at), np.maximum.reduceat(two, at))
    last = starts + sizes
    steps, here, word = [], last, np.arange(len(words))
    while len(here):
        edge = into[here]
        steps.append((word, piece[edge]))
        here = begin[edge]
        go = here > starts[word]
        here, word = here[go], word[go]
    word, ids = (np.concatenate(x) for x in zip(*steps[::-1]))
    order = np.argsort(word, kind="stable")
    return best[last], best[last] - second[last], ids[order], np.bincount(word, minlength=len(words))


def n_best(pieces: Pieces, word: str, n: int) -> list[tuple[float, list[int]]]:
    """(score, ids) of the ``n`` best paths (all, if fewer), by A* from the end; ties in the order they are reached."""
    ends = pieces.lattice(word)
    best, _, _ = forward(ends)
    agenda = [(-best[-1], 0, len(word), 0.0, None)]  # (-(score behind + heuristic), order, node, score behind, path)
    out, made = [], 1
    while agenda and len(out) < n:
        _, _, node, behind, path = heapq.heappop(agenda)
        if not node:
            steps = []
            while path:
                steps.append(path[0])
                path = path[1]
            out.append((behind, pieces.ids(word, steps)))
            continue
        for begin, score, i in ends[node]:
            if best[begin] > NEVER:
                heapq.heappush(agenda, (-(behind + score + best[begin]), made, begin, behind + score, ((begin, i), path)))
                made += 1
    return out


class Spans:
    """Arrays of numbers laid end to end in one that grows."""

    def __init__(self):
        self.flat, self.start, self.size, self.end = np.zeros(1 << 16, "<u4"), array("q"), array("i"), 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Spans one after another in ``ids``."""
        n = self.end + len(ids)
        if n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(n, "<u4")])
        self.flat[self.end : n] = ids
        self.start.frombytes((self.end + np.cumsum(sizes) - sizes).astype(np.int64).tobytes())
        self.size.frombytes(sizes.astype(np.int32).tobytes())
        self.end = n


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans of ``flat`` one after another."""
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)]


class Words(dict):
    """Word -> its number among those held. For each: score, loss of the second-best path and ids of the best one. Holds
    about ``most`` words; when there are more, those go that no text had again since the last time."""

    def __init__(self, pieces: Pieces, most: int = HELD):
        self.pieces, self.most, self.others = pieces, most, {}
        self.normal = ""  # the normalised text last split
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.score, self.loss, self.ids, self.again = array("d"), array("d"), Spans(), np.zeros(0, bool)

    def _add(self, words: list[str], score: np.ndarray, loss: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        at = len(self.score)
        self.update(zip(words, range(at, at + len(words))))
        self.score.frombytes(score.astype(float).tobytes())
        self.loss.frombytes(loss.astype(float).tobytes())
        self.ids.add(ids, sizes)

    def make_room(self) -> None:
        if len(self.score) <= self.most:
            return
        keep = self.again[: len(self.score)]
        held = [(w, i) for w, i in self.items() if i < len(keep) and keep[i]][-self.most // 2 :]
        words, at = [w for w, _ in held], np.array([i for _, i in held], np.int64)
        score, loss, start, size = (np.frombuffer(x, x.typecode)[at] for x in (self.score, self.loss, self.ids.start, self.ids.size))
        ids = gather(self.ids.flat, start, size)
        self._empty()
        self._add(words, score, loss, ids, size)

    def learn(self, keys: set[str]) -> None:
        """Segments the words among ``keys`` that are not held, together."""
        new = [k for k in keys if k not in self and len(k) < LONG and k != BARE]
        if not new:
            return
        words = list(map(self.word, new))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.pieces.single_codes, codes), len(self.pieces.single_codes) - 1)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        known = np.add.reduceat(self.pieces.single_codes[at] != codes, np.cumsum(sizes) - sizes) == 0
        if not known.all():
            new, words = ([x for x, k in zip(some, known) if k] for some in (new, words))
        if words:
            self._add(new, *forward_all(self.pieces, words))

    def __missing__(self, key: str) -> int:
        word, p = self.word(key), self.pieces
        best, second, into = forward(p.lattice(word))
        k, ids = len(word), []
        while k:
            begin, i = into[k]
            ids += (i,) if i >= 0 else p.expand(word[begin])[::-1]
            k = begin
        self._add([key] if len(word) <= LONG else [], np.array([best[-1]]), np.array([best[-1] - second[-1]]), np.array(ids[::-1], "<u4"), np.array([len(ids)]))
        return len(self.score) - 1

    @staticmethod
    def word(key: str) -> str:
        """A key is a word without its space mark; BARE marks one that has none."""
        return key[1:] if key[:1] == BARE else key if key == "\n" else SPACE + key

    def alternatives(self, word: str, n: int) -> list[tuple[float, np.ndarray]]:
        """(loss, ids) of the n best paths but the best one, which stands first with no ids."""
        found = self.others.get((word, n))
        if found is None:
            paths = n_best(self.pieces, self.word(word), n + 1)
            score, best = paths[0][0], self._best(word)
            found = [(0.0, None)] + [(score - s, np.array(i, "<u4")) for s, i in paths if i != best][: n - 1]
            if len(word) <= LONG:
                if len(self.others) > 10_000:
                    self.others.clear()
                self.others[word, n] = found
        return found

    def _best(self, word: str) -> list[int]:
        at = self[word]
        start = self.ids.start[at]
        return self.ids.flat[start : start + self.ids.size[at]].tolist()

    def split(self, text: str) -> list[str]:
        """The normalised text's keys, cut where no piece lies across."""
        text = self.normal = self.pieces.normalise(text)
        if not text:
            return []
        if SPACE * 2 in text or text[-1] == SPACE or BARE in text:
            words = re.findall(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n", text)
            return [w if w == "\n" else w[1:] if w[0] == SPACE and w[1:2] not in (BARE, "\n") else BARE + w for w in words]
        keys = text.replace("\n", f"{SPACE}\n{SPACE}{BARE}").split(SPACE)
        return [BARE + keys[0], *keys[1:]] if keys[0] else keys[1:]

    def look_up(self, words: list[str]) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """(score, losses, ids, ids of each word) of the words' best paths."""
        parts = []
        for i in range(0, len(words), CHUNK):
            some = words[i : i + CHUNK]
            if i:
                self.make_room()
                self.learn(set(some))
            before = len(self.score)
            at = np.fromiter(map(self.__getitem__, some), np.int64, len(some))
            if len(self.again) < len(self.score):
                self.again = np.concatenate([self.again, np.zeros(len(self.score) + self.most // 4 - len(self.again), bool)])
            self.again[at[at < before]] = True
            size = np.frombuffer(self.ids.size, np.int32)[at]
            parts.append((np.frombuffer(self.score)[at].sum(), np.frombuffer(self.loss)[at], gather(self.ids.flat, np.frombuffer(self.ids.start, np.int64)[at], size), size))
        if len(parts) == 1:
            return parts[0]
        return (sum(x[0] for x in parts), *(np.concatenate([x[k] for x in parts]) for k in (1, 2, 3)))

    def segment_all(self, texts: Iterable[str], n: int = N) -> Iterator[tuple[str, list[tuple[float, np.ndarray]]]]:
        """(normalised text, :meth:`segment` of it) for each text. New words of several texts are segmented together."""
        held, size = [], 0
        for text in texts:
            words = self.split(text)
            held.append((self.normal, words))
            size += len(words)
            if size > CHUNK:
                yield from self._finish(held, n)
                held, size = [], 0
        yield from self._finish(held, n)

    def _finish(self, held: list[tuple[str, list[str]]], n: int) -> Iterator[tuple[str, list[tuple[float, np.ndarray]]]]:
        self.make_room()
        self.learn(set().union(*(words[:CHUNK] for _, words in held)))
        for normal, words in held:
            yield normal, self._best_of(words, n)

    def segment(self, text: str, n: int = N) -> list[tuple[float, np.ndarray]]:
        """(score, ids) of the text's ``n`` best segmentations (all, if fewer), best first."""
        return next(self.segment_all([text], n))[1]

    def _best_of(self, words: list[str], n: int) -> list[tuple[float, np.ndarray]]:
        if not words:
            return [(0.0, np.zeros(0, "<u4"))]
        score, loss, whole, sizes = self.look_up(words)
        out = [(float(score), whole)]
        if n == 1:
            return out
        at = [i for i in self._least(loss, min(n - 1, len(loss))).tolist() if loss[i] < math.inf]
        options = [self.alternatives(words[i], n) for i in at]
        agenda, seen = [(0.0, (0,) * len(at))], {(0,) * len(at)}
        ends = None
        while agenda:
            cost, choice = heapq.heappop(agenda)
            if any(choice):
                if ends is None:
                    ends = np.cumsum(sizes)
                parts, last = [], 0
                for i, c, o in sorted(zip(at, choice, options), key=lambda x: x[0]):
                    if c:
                        parts += [whole[last : ends[i] - sizes[i]], o[c][1]]
                        last = ends[i]
                out.append((float(score - cost), np.concatenate([*parts, whole[last:]])))
                if len(out) == n:
                    break
            for j, o in enumerate(options):
                nxt = (*choice[:j], choice[j] + 1, *choice[j + 1 :])
                if nxt[j] < len(o) and nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(agenda, (sum(o[c][0] for o, c in zip(options, nxt)), nxt))
        return out

    @staticmethod
    def _least(loss: np.ndarray, k: int) -> np.ndarray:
        """The first k positions by (loss, position)."""
        kth = np.partition(loss, k - 1)[k - 1]
        at = np.flatnonzero(loss <= kth)
        return at[np.argsort(loss[at], kind="stable")][:k]

    def decode(self, ids: np.ndarray) -> str:
        """The normalised text that ids stand for, without the space mark in front."""
        return self.plain(self.joined(ids).decode(errors="replace"))

    def joined(self, ids: np.ndarray) -> bytes:
        p = self.pieces
        return gather(p.utf8, p.utf8_start[ids], p.utf8_size[ids]).tobytes()

    @staticmethod
    def plain(text: str) -> str:
        """Normalised text without space marks."""
        text = text.replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


_held: dict[str, Words] = {}


def words_for(model: str) -> Words:
    return _held.get(model) or _held.setdefault(model, Words(Pieces(model)))


def segment_documents(docs: DataFrame, model: str | None = None, n: int = N, decode: bool = False) -> DataFrame:
    """A row for each document and each of its ``n`` best segmentations: doc_id, rank from 1, score, n_ids, ids_crc32
    (of the ids as little-endian 32-bit numbers) and ids.

    A null or empty text has one segmentation, without ids, of score 0; a text with fewer segmentations has all. Texts
    are segmented whole, and a rank's ties are broken the same way in every run. Unknown characters become byte pieces.
    Rows that share a doc_id are segmented each; other columns are not read; an empty table gives no rows. Nothing is
    shuffled, and memory is bounded by a text and the words held. With ``decode``, every row's ids are decoded too:
    text_crc32 (of the decoded text in UTF-8) and round_trip (whether it equals the normalised text)."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_for(path)
        names = ["doc_id", "rank", "score", "n_ids", "ids_crc32", "ids", *(["text_crc32", "round_trip"] if decode else [])]
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            doc, rank, score, ids, crc, same = zip(*rows)
            sizes = np.array([len(x) for x in ids], np.int32)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            more = [pa.array(crc, pa.int64()), pa.array(same, pa.bool_())] if decode else []
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(rank, pa.int32()), pa.array(score, pa.float64()), pa.array(sizes), pa.array([zlib.crc32(x) for x in ids], pa.int64()), lists, *more], names=names)

        for batch in batches:
            for d, (normal, found) in zip(batch.column(0), words.segment_all((t.as_py() or "" for t in batch.column(1)), n)):
                crc = same = None
                if decode:
                    whole, normal = normal.encode(), words.plain(normal)
                    whole_crc = zlib.crc32(normal.encode())
                for r, (s, x) in enumerate(found, 1):
                    if decode:
                        crc, same = whole_crc, words.joined(x) == whole  # the same bytes decode to the same text
                        if not same:
                            back = words.decode(x)
                            crc, same = zlib.crc32(back.encode()), back == normal
                    rows.append((d.as_py(), r, s, x, crc, same))
                    size += len(x) + 16
                    if size > BATCH:
                        yield flush()
                        rows.clear()
                        size = 0
        if rows:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT + DECODED if decode else RESULT)


def decode_documents(segmented: DataFrame, model: str | None = None) -> DataFrame:
    """``segmented`` (any columns, one of them ``ids``) with ``text``, the normalised text that the ids stand for; null
    ids give null."""
    path = model or default_model()
    kept = [c for c in segmented.columns if c != "text"]
    schema = segmented.select(*[F.col(f"`{c}`") for c in kept], F.lit("").alias("text")).schema
    schema["text"].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_for(path)
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids"))
            texts = pa.array([None if not x.is_valid else words.decode(np.array(x.as_py(), np.int64)) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*b.schema.names, "text"])

    return segmented.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def op1_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_documents(table(spark, sf_dir, "documents"), decode=True)
