import hashlib
import random
import zlib

import numpy as np
import pytest

from quirework.llm import license_scan, line_dedup, ngram_join, packing, segment
from quirework.llm.workspace import Workspace

from .helpers import components, deduped_lines, documents, prose, shingles


def corpus(seed=0, n=60):
    """Copies, near copies, a shared passage, short, empty, null and long texts."""
    rng = random.Random(seed)
    passage = prose(rng, 60, 500)
    rows = []
    for i in range(n):
        kind = i % 10
        if kind < 3 or len(rows) < 5:
            t = prose(rng, rng.randrange(1, 200), 500)
        elif kind < 6:
            w = (rows[rng.randrange(len(rows))][1] or "").split() or ["x"]
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
            t = " ".join(w)
        elif kind == 6:
            t = passage + " " + prose(rng, rng.randrange(1, 40), 500)
        elif kind == 7:
            t = rng.choice(["", None, " \n\t", "One", "one TWO three", "a b c d e"])
        else:
            t = rows[rng.randrange(len(rows))][1]
        rows.append((i, t))
    return rows + [(n, prose(rng, 5000, 3000))]


@pytest.mark.parametrize("seed", [0, 1])
def test_ngram_join_is_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_DF", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    rows = corpus(seed)
    got = ngram_join.ngram_components(documents(spark, rows, "d string"), Workspace(spark, "t")).collect()
    sets = {i: shingles(t) for i, t in rows}
    want = components(sets)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}
    assert len(got) == len(rows)


def test_ngram_join_without_rows_and_with_repeats(spark):
    assert ngram_join.ngram_components(documents(spark, []), Workspace(spark, "t")).collect() == []
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (3, "A  b c\nd e f"), (None, "a b c d e f"), (4, None)]
    got = sorted(ngram_join.ngram_components(documents(spark, rows), Workspace(spark, "t")).collect(), key=str)
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == [("3", 2, 3), ("4", 0, 4), ("7", 2, 3), ("7", 2, 3), ("None", 2, 3)]
    kept = ngram_join.keep_one(documents(spark, rows[:1] + rows[2:]), Workspace(spark, "t"))
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["3", "4", "None"]


def test_chains(spark):
    """Neighbours link, ends don't."""
    words = [f"q{i}" for i in range(100)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 40])) for i in range(15)]
    sets = {i: shingles(t) for i, t in rows}
    got = ngram_join.ngram_components(documents(spark, rows), Workspace(spark, "t")).collect()
    assert {r.doc_id: r.component_id for r in got} == components(sets)


def test_trie_agrees_with_sets():
    rng = np.random.default_rng(0)
    sets = [np.sort(rng.choice(60, rng.integers(1, 50), replace=False)).astype(np.uint64) for _ in range(80)]
    trie = ngram_join.Trie(sets)
    for probe in sets:
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, probe)) >= 75 * len(np.union1d(s, probe))]
        assert sorted(trie.links(np.sort(probe))) == want


def test_line_dedup(spark):
    rng = random.Random(3)
    lines = ["This line is long enough to go", "  this LINE is long enough to go\t", "short", "", "Ünïcode LINE that is long enough", "\u00a0nbsp stays at the end here\u00a0"]
    rows = [(i, rng.choice([None, "", "\n"]) if i % 9 == 0 else "\n".join(rng.choices([*lines, f"own line of document {i}"], k=rng.randrange(1, 9)))) for i in range(40)]
    rows += [(5, rows[5][1]), (None, lines[0]), (100, "x" * 30 + "\n" + lines[0] + "\n" + lines[0])]
    df = documents(spark, rows, "n_lines int")
    out = line_dedup.dedup_lines(df, Workspace(spark, "t")).collect()
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in out)
    want = sorted((str(i), n, n - len(t.split("\n")) if t or n == 1 else n, t) for i, n, t in deduped_lines(rows))
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
    assert line_dedup.dedup_lines(documents(spark, []), Workspace(spark, "t")).collect() == []


def test_line_runs_compact_and_anti_join(spark):
    runs = line_dedup.LineRuns(Workspace(spark, "t"), fanout=2)
    for doc, keys in ((9, [1, 2]), (8, [2, 3]), (7, [2]), (6, [4])):
        runs.add(spark.createDataFrame([(doc, k, k) for k in keys], "doc_id long, h1 long, h2 long"))
    assert {k: len(v) for k, v in runs.levels.items() if v} == {2: 1}
    assert [(r.h1, r.holder) for r in runs.frequent(3).collect()] == [(2, 9)]
    assert [r.h1 for r in runs.anti(spark.createDataFrame([(4, 4), (5, 5)], "h1 long, h2 long")).collect()] == [5]


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = corpus(5, 30) + [(99, "x" * 9000), (98, "Ｆｕｌｌ ǅ İstanbul don't 12ab\u0301 <|endoftext|>")]
    got = packing.pack_documents(documents(spark, rows, "sequence_id string"), Workspace(spark, "t")).collect()
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack_documents(documents(spark, []), Workspace(spark, "t")).collect() == []


def test_first_fit_decreasing_is_the_plain_rule():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 300)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room = []
    for i in np.argsort(-lengths, kind="stable"):
        b = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        room += [100] * (b == len(room))
        assert (bins[i], offsets[i]) == (b, 100 - room[b])
        room[b] -= lengths[i]


def all_paths(pieces, word):
    ends, out = pieces.lattice(word), []

    def walk(k, score, path):
        if not k:
            out.append((score, tuple(pieces.ids(word, path))))
        for begin, s, i in ends[k] if k else ():
            walk(begin, score + s, [(begin, i), *path])

    walk(len(word), 0, [])
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["the cat", "a  b ", "naïve é漢☃", "x\ny z", "  lead", "a \nb", "\x01a b", "a\x01\n\n b", "\n", "a \x01b", " \x01", "ab"])
@pytest.mark.parametrize("n", [1, 3, 7])
def test_segmentation_is_brute_force(text, n):
    words = segment.words_for(segment.default_model())
    every = all_paths(words.pieces, words.pieces.normalise(text))
    got = words.segment(text, n)
    assert [s for s, _ in got] == [s for s, _ in every[:n]]
    assert {(s, tuple(i.tolist())) for s, i in got} <= set(every) and len({tuple(i.tolist()) for _, i in got}) == len(got)
    assert all(words.decode(i) == text for _, i in got)


def test_segment_and_decode_tables(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "é " * 3000), (4, "z" * 500)]
    out = segment.segment_documents(documents(spark, rows, "ids string"))
    got = segment.decode_documents(out).collect()
    assert all(r.text == dict(rows)[r.doc_id].rstrip("\0") if r.doc_id in (3, 4) else True for r in got)
    assert {(r.n_ids, r.score) for r in got if r.doc_id in (1, 2)} == {(0, 0)}
    assert sum(r.doc_id == 3 for r in got) == 6 and sum(r.doc_id is None and r.text == "é " * 3000 for r in got) == 3
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<i4").tobytes()) and len(r.ids) == r.n_ids for r in got)
    assert segment.segment_documents(documents(spark, [])).collect() == []


def test_patience_alignment():
    assert license_scan.longest_increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])
    t = "b c a d e f g a h".split()
    assert [x for x, _ in license_scan.patience("x b c y a d q e f g a h z".split(), t)] == [1, 2, 4, 5, 7, 8, 9, 10, 11]
    assert license_scan.patience([], t) == []


def test_license_scan(spark):
    full = license_scan.TEMPLATES["MIT-text"]
    words = full.split()
    changed = " ".join(w for i, w in enumerate(words) if i % 12)
    mit = license_scan.TEMPLATES["MIT"]
    rng = random.Random(0)
    rows = [(1, prose(rng, 300) + " " + full + " " + prose(rng, 50)), (2, changed), (3, " ".join(words[: len(words) // 2])), (4, f"{mit} {mit}\n{mit}"), (5, None), (6, ""), (7, prose(rng, 4000))]
    got = license_scan.scan_licenses(documents(spark, rows, "license int")).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append((r.license, r.start, r.end, round(r.coverage, 2)))
    n = len(license_scan.words_of(full))
    assert found[1] == [("MIT-text", 300, 300 + n, 1.0)]
    assert found[2][0][0] == "MIT-text" and found[2][0][3] > 0.85
    assert found[4] == [("MIT", 0, 5, 1.0), ("MIT", 5, 10, 1.0), ("MIT", 10, 15, 1.0)]
    assert set(found) == {1, 2, 4}


def test_text_digests_of_the_line_query(spark, tmp_path):
    documents(spark, [(1, "a\nb"), (2, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.kept_sha256 for r in line_dedup.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: hashlib.sha256(b"a\nb").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}


def test_partnered_is_the_pairwise_rule():
    rng = np.random.default_rng(0)
    for _ in range(60):
        k = int(rng.integers(1, 30))
        t, m = np.sort(rng.integers(0, 5, k)).astype(np.uint64), rng.integers(2, 60, k)
        want = [any(i != j and t[i] == t[j] and ngram_join.compatible(m[j : j + 1], int(m[i]), 75)[0] for j in range(k)) for i in range(k)]
        assert ngram_join.partnered(t, m, 75).tolist() == want


def test_text_hash_is_sparks(spark):
    from pyspark.sql import functions as F

    texts = ["", "a", "é漢" * 50, "x" * 1000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h"))
    assert all(r.h == ngram_join.text_hash(r.t) for r in df.collect())


def test_rows_that_share_an_id(spark):
    long = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(1, long), (1, "other words stand here under the same id"), (2, long + " tail"), (3, "other words stand here under the same id now")]
    got = sorted((r.doc_id, r.component_id) for r in ngram_join.ngram_components(documents(spark, rows), Workspace(spark, "t")).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_the_query_decodes_what_it_segments(spark, tmp_path):
    rows = [(1, None), (2, "one  two "), (3, "naïve é漢☃\n\n x"), (4, "▁a ▁"), (5, "word " * 400)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = segment.op1_segment(spark, str(tmp_path))
    words = segment.words_for(segment.default_model())
    plain = {i: words.pieces.normalise(t or "").replace("▁", " ").removeprefix(" ") for i, t in rows}
    got = out.collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5} and all(r.round_trip for r in got)
    assert all(r.text_crc32 == zlib.crc32(plain[r.doc_id].encode()) for r in got)
    assert all(r.text == plain[r.doc_id] for r in segment.decode_documents(out).collect())


def test_an_interrupted_notice_is_found_whole():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.COVERAGE)
    foreign = " ".join(f"x{i}" for i in range(60))
    found = [x for x in scanner.scan(f"a b Released under {foreign} the MIT License. End") if x[0] == "MIT"]
    assert found == [("MIT", 2, 67, 5)]
    words = license_scan.TEMPLATES["Apache-2.0-header"].split()
    whole = len(license_scan.words_of(" ".join(words)))
    text = " ".join([*words[:40], *(f"x{i}" for i in range(200)), *words[40:]])
    assert [(a, b, n) for name, a, b, n in scanner.scan(text) if name == "Apache-2.0-header"] == [(0, whole + 200, whole)]
    twice = f"Released under the MIT License. and Released under {foreign} the MIT License. Released under the MIT License."
    assert [x[1:] for x in scanner.scan(twice) if x[0] == "MIT"] == [(0, 5, 5), (6, 71, 5), (71, 76, 5)]


def unigram_model(path, pieces):
    """A unigram model of given pieces and scores, in the model files' protocol-buffer form."""
    import struct

    def field(number, body):
        return bytes([number << 3 | 2, *((len(body) & 127 | 128, len(body) >> 7) if len(body) > 127 else (len(body),))]) + body

    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((p, s, 1) for p, s in pieces)]
    body = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([3 << 3, kind])) for p, s, kind in rows)
    trainer = bytes([3 << 3, 1])  # unigram
    normaliser = field(1, b"identity") + bytes([3 << 3, 1, 4 << 3, 1, 5 << 3, 1])
    path.write_bytes(body + field(2, trainer) + field(3, normaliser))
    return str(path)


def test_unigram_n_best_is_the_librarys(tmp_path):
    import sentencepiece

    rng = random.Random(0)
    letters = "abcde"
    pieces = {"▁": -4.1, **{c: -5.0 - rng.random() for c in letters}}
    while len(pieces) < 60:
        p = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 4)))
        pieces.setdefault(rng.choice(["", "▁"]) + p, -3.0 - 4 * rng.random())
    model = unigram_model(tmp_path / "unigram.model", sorted(pieces.items()))
    sp, words = sentencepiece.SentencePieceProcessor(model_file=model), segment.Words(segment.Pieces(model))
    for _ in range(200):
        text = " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 4)))
        text = text.replace("ab", rng.choice(["ab", "axb"]))  # an unknown character
        got = words.segment(text, 4)
        want = sp.nbest_encode_as_ids(text, 4)
        assert got[0][1].tolist() == sp.encode(text)
        score = lambda ids: sum(sp.get_score(i) if i else min(pieces.values()) - segment.UNKNOWN for i in ids)
        assert [s for s, _ in got] == pytest.approx([score(i) for i in want], abs=1e-4)
        assert [s for s, _ in got] == pytest.approx([score(i.tolist()) for _, i in got], abs=1e-4)


def test_words_that_a_full_cache_drops_are_segmented_alike():
    model = segment.default_model()
    few, all_ = segment.Words(segment.Pieces(model), most=50), segment.words_for(model)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abtheionré漢,.") for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(0, 80))) for _ in range(60)]
    for _ in range(2):
        for text in texts:
            assert [(s, i.tolist()) for s, i in few.segment(text)] == [(s, i.tolist()) for s, i in all_.segment(text)]
    assert len(few) < 500
    one_by_one = [all_.segment(t) for t in texts]
    together = [found for _, found in segment.Words(segment.Pieces(model)).segment_all(texts)]
    assert [[(s, i.tolist()) for s, i in x] for x in together] == [[(s, i.tolist()) for s, i in x] for x in one_by_one]


def test_packing_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    tok, words = Tokenizer.from_file(packing.default_tokenizer()), packing.WordIds(packing.default_tokenizer(), most=3000)
    whole = lambda t: np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    assert words.by_word
    for c in sorted(packing.PLAIN):  # every letter that is cut off from marks, alone, between others, with a mark
        for t in (c, f"a{c}b", f"{c}.", f"x{c}...", f"{c}{c.upper()}!?"):
            assert words.of(t) == whole(t), t
    rng = random.Random(0)
    letters = "aZeßéÉÑıİǅǆſΣσςДяäÄŁĐŉǰΐﬁ漢字かなカ한ａＡⅣªº"
    marks = ".,;:!?'\"()[]{}<|>-_#$%&*+/\\~^`@=¡¿«»…—’“”·„̸̧́̇̈​‍﻿­\u0085  　☃🙂\U0001f3fd"
    pieces = [*letters, *marks, *"0129٣²", "'s", "'LL", "n't", "<|endoftext|>", "<|startoftext|>", "word", "Café", "Kocaelİ", " ", " ", " ", "\n", "\t", "\x0b", "\x1c", "\x1f"]
    for _ in range(20_000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))
        assert words.of(t) == whole(t), t
    assert words.of("KOCAELİ, 2 dedİ. İ- " * 3) == whole("KOCAELİ, 2 dedİ. İ- " * 3)


def test_packing_looks_different_words_up_once(monkeypatch):
    """Work follows a slice's different words, not all of them, and plain letters skip the tokenizer's text steps."""

    class Counted(packing.WordIds):
        looked = 0

        def __getitem__(self, word):
            self.looked += 1
            return super().__getitem__(word)

    words = Counted(packing.default_tokenizer())
    whole = words.encode
    want = whole("Same wörd, again. " * 10_000)
    monkeypatch.setattr(words, "encode", lambda word: whole(word) if word in ",." else pytest.fail(f"{word} encoded as a text"))
    assert words.of("Same wörd, again. " * 10_000) == want
    assert words.looked < 20


def test_packing_ids_of_many_texts(monkeypatch):
    """Slices, long texts cut behind white space, empty texts, arrays that begin within another; few words held."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "SLICE", 64)
    monkeypatch.setattr(packing, "CHUNK", 7)
    tok, words = Tokenizer.from_file(packing.default_tokenizer()), packing.WordIds(packing.default_tokenizer(), most=40)
    rng = random.Random(2)
    letters = [*"abeéßAÉİſñ漢", "'s", ".", ",,", "7", "<|endoftext|>", "\u0301", "\xa0", " ", " ", "\n", "\t ", "\x1f"]
    texts = ["", " ", "x" * 500, "\n" * 200, *("".join(rng.choices(letters, k=rng.choice([0, 3, 20, 60, 300]))) for _ in range(400))]
    for some in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["before", *texts, "behind"]).slice(1, len(texts)), pa.array([None, "a b", None, None, "c", None]), pa.array([None]).cast("string"), pa.array([], pa.string())):
        got = [np.frombuffer(x, "<u4").tolist() for x in words.of_all(some)]
        assert got == [tok.encode(t or "", add_special_tokens=False).ids for t in some.to_pylist()]
        assert len(words) + len(words.older) < 80
        words.rest()
        assert not words.older


def test_packing_with_another_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "Two  words, AND\n more don't"
    assert not packing.WordIds(path).by_word
    (row,) = packing.pack_documents(documents(spark, [(1, text)]), Workspace(spark, "t"), tokenizer=path).collect()
    ids = [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 1]
    assert (row.doc_tokens, row.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_packing_deals_identical_rows_apart(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    rows = [(None, None)] * 400
    df = documents(spark, rows).repartition(4)
    ws = Workspace(spark, "t")
    got = packing.pack(ws.put("pieces", packing.cut_documents(df, packing.default_tokenizer())), 400, group=40).collect()
    sizes = {}
    for r in got:
        sizes[r.sequence_id >> 32] = sizes.get(r.sequence_id >> 32, 0) + 1
    assert sum(sizes.values()) == 400 and len(sizes) == 10 and max(sizes.values()) < 80
    assert all((r.doc_id, r.length, r.doc_tokens) == (None, 1, 1) for r in got)


def test_line_dedup_of_long_documents_is_linear(spark):
    import time

    lines = [f"This line number {i} is long enough" for i in range(100_000)]
    df = documents(spark, [(i, "\n".join([*lines, f"own {i}"])) for i in range(3)])
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(df, Workspace(spark, "t")).select("doc_id", "n_lines", "n_dropped", "text").collect()}
    assert got == {0: (100_001, 100_000, "own 0"), 1: (100_001, 100_000, "own 1"), 2: (100_001, 0, "\n".join([*lines, "own 2"]))}
    assert time.time() - began < 60


def test_lines_of_rows_that_share_an_id(spark):
    """Two rows of one doc_id are one holder."""
    line = "This line is long enough to go"
    two = documents(spark, [(1, line), (1, f"{line}\nx"), (2, line)])
    assert all(r.n_dropped == 0 for r in line_dedup.dedup_lines(two, Workspace(spark, "t")).collect())
    three = documents(spark, [(1, line), (1, f"{line}\nx"), (2, line), (None, line), (3, f"y\n{line}\n{line}")])
    got = sorted((str(r.doc_id), r.n_dropped, r.text) for r in line_dedup.dedup_lines(three, Workspace(spark, "t")).collect())
    assert got == [("1", 1, ""), ("1", 1, "x"), ("2", 1, ""), ("3", 0, f"y\n{line}\n{line}"), ("None", 1, "")]


def test_one_row_of_each_component_stays(spark):
    a, b, c = ("first text with more words than five", "quite another text of some length here", "the third of them is not like the others")
    rows = [(0, a), (1, a), (1, b), (2, c), (2, c), (3, None), (3, None), (None, a)]
    df = documents(spark, rows, "row string")
    got = sorted((str(r.doc_id), r.text or "") for r in ngram_join.keep_one(df, Workspace(spark, "t")).collect())
    assert got == sorted([("0", a), ("1", b), ("2", c), ("3", ""), ("3", ""), ("None", a)])
    assert ngram_join.keep_one(df.limit(0), Workspace(spark, "t")).collect() == []


@pytest.mark.parametrize("seed", [2, 3])
def test_crowded_families_are_brute_force(spark, seed, monkeypatch):
    """A large group of near copies, shingles that many sets have, and sets beside them that link with few."""
    monkeypatch.setattr(ngram_join, "HOT_DF", 4)
    monkeypatch.setattr(ngram_join, "CROWD", 6)
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    monkeypatch.setattr(ngram_join, "CELL", 7)
    rng = random.Random(seed)
    base, passage = prose(rng, 60, 900).split(), prose(rng, 30, 900)
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(0, 3 if i % 3 else 6)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(50)}"
        rows.append((i, " ".join(w) if i % 4 else passage + " " + " ".join(w[: rng.randrange(1, 60)])))
    got = ngram_join.ngram_components(documents(spark, rows), Workspace(spark, "t")).collect()
    sets = {i: shingles(t) for i, t in rows}
    want = components(sets)
    assert len(set(want.values())) > 5
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}


def test_license_scan_finds_what_every_window_does():
    """A template is found in a text if and only if patience alignment covers enough of it in some window."""
    rng = random.Random(0)
    templates = {"one": "the quick brown fox jumps over the lazy dog today", "two": "this text may be copied by any person for the good of all and for any use", "short": "copied by any person"}
    scanner = license_scan.Scanner(templates, 0.8)
    hits = 0
    for _ in range(400):
        words = []
        while len(words) < 40:
            kind = rng.randrange(4)
            if kind:
                words += [f"f{rng.randrange(20)}" for _ in range(rng.randrange(6))]
            if kind != 1:
                t = templates[rng.choice(list(templates))].split()
                for _ in range(rng.randrange(4)):
                    i = rng.randrange(len(t))
                    t[i : i + rng.randrange(2)] = [] if rng.random() < 0.5 else [rng.choice(["fox", "any", "zzz"])]
                words += t
        found = scanner.scan(" ".join(words))
        for name, t in scanner.words.items():
            slack = max(2, len(t) // 4)
            best = max(len(license_scan.patience(words[a : a + len(t) + k], t)) for a in range(len(words)) for k in (-slack, 0, slack))
            some = [x for x in found if x[0] == name]
            hits += len(some)
            if best >= scanner.need[name]:
                assert some, (name, words)
            assert all(n >= scanner.need[name] and n <= b - a for _, a, b, n in some)
            spans = sorted(x[1:3] for x in some)
            assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
            for _, a, b, n in some:  # what is stated can be aligned there
                assert len(license_scan.patience([w for w in words[a:b] if w in scanner.own[name]], t)) >= n or len(license_scan.patience(words[a:b], t)) >= n
    assert hits > 300


def test_license_scan_of_odd_rows(spark):
    mit = license_scan.TEMPLATES["MIT"]
    rows = [(None, mit), (1, mit), (1, mit), (2, f"{mit} {license_scan.TEMPLATES['GPL-3.0']}"), (3, None)]
    got = sorted(((str(r.doc_id), r.license, r.start) for r in license_scan.scan_licenses(documents(spark, rows, "start int")).collect()))
    assert got == [("1", "MIT", 0), ("1", "MIT", 0), ("2", "GPL-3.0", 5), ("2", "MIT", 0), ("None", "MIT", 0)]
    assert license_scan.scan_licenses(documents(spark, [])).collect() == []


def test_license_scan_of_very_long_texts():
    import time

    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.COVERAGE)
    began, n = time.time(), 16_000
    assert len(scanner.scan((license_scan.TEMPLATES["MIT-text"] + "\n") * n)) == n  # 10 MB
    assert time.time() - began < 30
