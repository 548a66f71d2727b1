"""Periodic runs and decontamination, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quirework.llm import decontaminate, periodic
from quirework.llm.workspace import Workspace

from .helpers import LOWER, documents, prose


def brute_runs(w, power=4, least=6):
    n, out = len(w), []
    for q in range(1, n // power + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            if size >= max(least, power * q) and not any(all(w[k] == w[k + d] for k in range(s, s + size - d)) for d in range(1, q)):
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("power, least", [(4, 6), (2, 2), (3, 5)])
def test_runs_are_brute_force(power, least):
    rng = random.Random(power)
    for _ in range(400):
        k = rng.randrange(1, 4)
        some = lambda n: [rng.randrange(1, k + 1) for _ in range(rng.randrange(n))]
        root = some(8) or [1]
        w = some(12) + root * rng.randrange(1, 8) + root[: rng.randrange(len(root))] + some(12)
        assert list(map(tuple, periodic.runs_of(w, power, least).tolist())) == brute_runs(w, power, least)


def test_range_minimum():
    rng = np.random.default_rng(0)
    for n in (1, 31, 32, 33, 700):
        v = rng.integers(0, 50, n).astype(np.int32)
        i, j = rng.integers(0, n, 300), rng.integers(0, n, 300)
        assert periodic.RangeMin(v).least(i, j).tolist() == [int(v[min(a, b) : max(a, b) + 1].min()) for a, b in zip(i, j)]


def test_pieces_hold_every_run():
    rng = random.Random(2)
    for _ in range(200):
        w = [rng.randrange(1, 9) for _ in range(rng.randrange(40))] + [1, 2, 3] * rng.randrange(7) + [rng.randrange(1, 9) for _ in range(rng.randrange(40))]
        found = [(lo + s, n, q) for lo, hi in periodic.pieces(np.array(w, np.int64), np.zeros(len(w), np.int64)) for s, n, q in periodic.runs_of(w[lo:hi]).tolist()]
        assert sorted(found, key=lambda r: (r[0], r[2])) == brute_runs(w)


def periodic_row(doc, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ends = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *ends, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_documents(spark, monkeypatch):
    monkeypatch.setattr(periodic, "CHUNK", 300)
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(1, 90), rng.choice([2, 9, 40]))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "x " * 3000), (-7, "a b c\n" * 9), (-7, "a b c\n" * 9), (None, "z z z z z z Z z")]
    got = periodic.digest(periodic.collapse_documents(documents(spark, rows, "runs string"), plant=True)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((periodic_row(i, t) for i, t in rows), key=str)
    assert periodic.digest(periodic.collapse_documents(documents(spark, []), plant=True)).collect() == []
    plain = {r.doc_id: r for r in periodic.collapse_documents(documents(spark, rows[-4:])).collect()}
    assert bytes(plain[203].text) == b"x" and plain[203].runs[0].asDict() == {"start": 0, "length": 3000, "period": 1} and plain[203].n_dropped == 2999


def test_periodic_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(1, 60), 3)) for i in range(80)] + [(5, "a a a a a a"), (90, None)]
    documents(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(periodic.SQL).fetchall()
    got = [tuple(r) for r in periodic.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def split(text):
    return re.findall(WORD, (text or "").translate(LOWER))


def brute_hits(rows, items, window=10):
    phrases = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            phrases.setdefault(tuple(w[i : i + window]), set()).add("null" if item is None else str(item))
    sizes = {len(p) for p in phrases}
    out = []
    for doc, text in rows:
        w, hit, names = split(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in phrases:
                    hit |= set(range(i, i + n))
                    names |= phrases[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


def leak_rows(seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.choice([3, 10, 11, 30, 60]), 60)) for i in range(12)] + [(3, "Twice THE same id, and-so on"), (None, "an item that has no id"), (40, None), (41, "...")]
    rows = []
    for i in range(80):
        t = prose(rng, rng.randrange(0, 120), 60)
        if i % 4 == 0:
            w = items[rng.randrange(14)][1].split()
            a = rng.randrange(len(w))
            t = t + " " + ", ".join(w[a : a + rng.randrange(1, 40)]).upper() + "\n" + t
        rows.append((i, t))
    return rows + [(80, None), (81, ""), (82, "été " + items[0][1] + " " + items[0][1]), (82, items[1][1] * 3), (None, items[2][1])], items


@pytest.mark.parametrize("most, shard", [(500_000, 2_000_000), (40, 100)])
def test_contaminated_documents(spark, most, shard, monkeypatch):
    """In one block of the test set and one shard a task, and in many."""
    monkeypatch.setattr(decontaminate, "build_index", lambda docs, build=decontaminate.build_index: build(docs, shard))
    rows, items = leak_rows(most)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated_documents(documents(spark, rows, "shard string"), bench, Workspace(spark, "t"), most=most).collect()
    assert sorted(((r.doc_id, r.n_words, sum(s.length for s in r.spans), list(r["items"])) for r in got), key=str) == brute_hits(rows, items)
    for r in got:
        ends = [(s.start, s.start + s.length) for s in r.spans]
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_contaminated_documents_without_rows(spark):
    rows, items = leak_rows(0)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contaminated_documents(documents(spark, []), bench, Workspace(spark, "t")).collect() == []
    got = decontaminate.contaminated_documents(documents(spark, rows), bench.limit(0), Workspace(spark, "t")).collect()
    assert len(got) == len(rows) and not any(r.spans or r["items"] for r in got)


def test_few_words_stand_in_every_list(spark):
    """A passage of one word: every place proposes an occurrence."""
    rows, items = [(1, "go " * 500), (2, "stop"), (3, "go " * 9)], [(0, "go " * 12)]
    got = decontaminate.contaminated_documents(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), Workspace(spark, "t")).collect()
    assert sorted((r.doc_id, sum(s.length for s in r.spans)) for r in got) == [(1, 500), (2, 0), (3, 0)]


def test_proximity(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(0, 60), 12)) for i in range(40)]
    items = [(i, prose(rng, rng.randrange(2, 5), 12)) for i in range(15)]
    ws = Workspace(spark, "t")
    index = ws.put("index", decontaminate.build_index(documents(spark, rows), 300))
    ids = {(r.shard, r.doc_no): r.doc_id for r in index.where("doc_no is not null").collect()}
    found = decontaminate.search(index, spark.createDataFrame(items, "item_id long, text string"), within=7)
    got = sorted((ids[r.shard, r.doc_no], int(r["item"]), r.start, r.length) for r in found.collect())
    want = []
    for doc, text in rows:
        w = split(text)
        for item, phrase in items:
            need = set(split(phrase))
            own = [(b - a, a) for a in range(len(w)) for b in range(a + 1, min(len(w), a + 7) + 1) if need <= set(w[a:b])]
            if own:
                want.append((doc, item, min(own)[1], min(own)[0]))
    assert got == sorted(want) and got


def test_decontamination_sql(spark, tmp_path):
    import duckdb

    rows, items = leak_rows(3)
    documents(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(decontaminate.SQL).fetchall()
    got = [tuple(r)[:6] for r in decontaminate.op13_decontaminate(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
