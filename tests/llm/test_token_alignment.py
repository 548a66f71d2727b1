"""Cross-tokenizer alignment, against plain use of both tokenizers."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import pytest

from quirework.llm import token_align
from quirework.llm.workspace import Workspace

from .helpers import documents, prose

BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]


def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = token_align.default_tokenizers()
    one = Tokenizer.from_file(a)
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=b)


def brute(rows):
    one, two = tokenizers()
    byte = {chr(b): b for b in BYTES} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in BYTES)}
    docs = []
    for doc, text in rows:
        raw = (" " + (text or "")).encode()
        e, b = one.encode(raw.decode(), add_special_tokens=False), two.encode(text or "")
        own_a = [bytes(byte[c] for c in t) for t in e.tokens]
        own_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        groups = []
        if text and b"".join(own_a) == raw == b"".join(own_b):
            at_a, at_b = list(accumulate(map(len, own_a))), list(accumulate(map(len, own_b)))
            x, y = iter(zip(at_a, e.ids)), iter(zip(at_b, b))
            for end in sorted(set(at_a) & set(at_b)):
                pair = ([], [])
                for side, tokens in zip(pair, (x, y)):
                    for at, i in tokens:
                        side.append(i)
                        if at == end:
                            break
                groups.append(pair)
        docs.append((doc, groups))
    counts = Counter(p for _, groups in docs for p in {(i, j) for x, y in groups for i in x for j in y})
    top = defaultdict(int)
    for (i, _), n in counts.items():
        top[i] = max(top[i], n)
    out = []
    for doc, groups in docs:
        links = [(i, j) for x, y in groups for i in x for j in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sizes = (sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links))
        out.append((doc, *sizes, sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def rows_of(seed, n):
    rng = random.Random(seed)
    alphabet = list("ab c d'sé\n\n \t\r  　\xa0<|endoftext|>0x0A1234,.!?;)}日本\U0001f600\x1c\x85​")
    rows = [(i, "".join(rng.choices(alphabet, k=rng.randrange(40)))) for i in range(n)]
    rows += [(1000 + i, prose(rng, rng.randrange(60), 200) + "\nThe END of it.") for i in range(n)]
    rows += [(2000, None), (2001, ""), (2002, " "), (2003, "<s> </s> <unk> <0x0A> <|endoftext|>"), (2004, ";\r\nfoo;\r bar\t"), (2005, "a ▁ mark"), (2006, "x" * 3000)]
    return rows + [(2007, "日" * 900 + "abc"), (2008, "same text"), (2008, "same text"), (None, "no id"), (2009, "end\t"), (2010, "end \n ")]


@pytest.mark.parametrize("sizes", [{}, {"run_units": 300, "parts": 5, "fan": 3}])
def test_alignment_is_brute_force(spark, sizes, monkeypatch):
    """With one run a task, and with so many that they are spilled twice over; memory for few units."""
    if sizes:
        monkeypatch.setattr(token_align, "FRAME", 7)
        monkeypatch.setattr(token_align, "UNITS", 100)
        monkeypatch.setattr(token_align, "HELD", 100)
    rows = rows_of(1, 150)
    got = token_align.align_documents(documents(spark, rows, "run string").repartition(3), Workspace(spark, "t"), **sizes).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_alignment_without_rows_or_tokens(spark):
    assert token_align.align_documents(documents(spark, []), Workspace(spark, "t")).collect() == []
    got = token_align.align_documents(documents(spark, [(1, None), (2, ""), (2, "▁")]), Workspace(spark, "t")).collect()
    assert sorted(map(tuple, got)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 2)]


def test_tokenizers_of_other_rules_align_whole_texts():
    aligner = token_align.Aligner(*token_align.default_tokenizers())
    assert aligner.by_unit
    text = "One two,\nthree  four\tfive"
    numbers, _ = aligner.units([text])
    parts = b";".join(aligner.texts[i] for i in numbers)
    aligner.forget()
    aligner.find = lambda t: [t]
    (whole,), _ = aligner.units([text])
    assert aligner.texts[whole] == parts and len(numbers) == 4


def test_settle_gives_every_run_its_totals():
    import io

    import numpy as np

    rng = random.Random(3)
    runs = [sorted({(rng.randrange(9) << 32) | rng.randrange(9): rng.randrange(1, 5) for _ in range(rng.randrange(1, 60))}.items()) for _ in range(23)]
    total, top = Counter(), defaultdict(int)
    for r in runs:
        for p, n in r:
            total[p] += n
    for p, n in total.items():
        top[p >> 32] = max(top[p >> 32], n)
    for fan in (2, 4, 100):
        own = []
        for r in runs:
            blob = b"".join(token_align.frame(np.diff(np.array([p for p, _ in r[i : i + 5]], np.int64), prepend=0), np.array([n for _, n in r[i : i + 5]])) for i in range(0, len(r), 5))
            own.append(token_align.Pairs(io.BytesIO(blob), 0, len(blob)))
        token_align.settle(own, fan=fan)
        for r, o in zip(runs, own):
            blob = b"".join(o.out)
            got = [v for (values,) in token_align.frames(io.BytesIO(blob), 0, len(blob), 1) for v in values.tolist()]
            assert got == [2 * total[p] + (total[p] == top[p >> 32]) for p, _ in r]
