import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.llm import exact_dedup, quality, sharding, topk, url_filter
from quirework.llm.workspace import Workspace

from .helpers import documents, prose


def top_k_plain(rows, queries, k):
    out = set()
    for q, v in queries:
        if v is not None:
            s = sorted(((-int(np.dot(v, w)), i) for i, w in rows if w is not None and i != q and len(w) == len(v)))
            out |= {(q, r, i, -x) for r, (x, i) in enumerate(s[:k], 1)}
    return out


@pytest.mark.parametrize("block", [3, 100])
def test_top_k_is_brute_force(spark, block):
    rng = random.Random(0)
    rows = [(i, [float(rng.randrange(-9, 9) * (1 if i % 3 else 40)) for _ in range(6)]) for i in range(120)]
    rows += [(i, rows[5][1]) for i in range(200, 240)] + [(300, None), (301, [1.0, 2.0]), (302, [1.0, 3.0]), (303, [])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    queries = [r for r in rows if r[0] % 7 == 0 or r[0] >= 300]
    got = topk.top_k(df, spark.createDataFrame(queries, df.schema), Workspace(spark, "t"), block=block).collect()
    assert {tuple(r) for r in got} == top_k_plain(rows, queries, 5) and len(got) == len(set(map(tuple, got)))


def test_top_k_small_and_odd_input(spark):
    df = spark.createDataFrame([(0, [1.0, None]), (50, [float("nan"), 1.0]), (100, [0.5, -0.001]), (150, None), (1, [2.0, 2.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    rows = df.select("vec_id", topk.quantise(F.col("embedding")).alias("vector"))
    got = topk.top_k(rows, rows.where("vec_id % 50 = 0"), Workspace(spark, "t")).collect()
    assert [tuple(r) for r in got] == [(100, 1, 1, 128 * 512 - 512)]
    assert topk.top_k(rows.limit(0), rows.limit(0), Workspace(spark, "t")).collect() == []


def dedup_plain(rows):
    size, keep = Counter(t or "" for _, t in rows), {}
    for i, t in rows:
        keep[t or ""] = max(keep.get(t or "", i), i)
    return sorted((i, keep[t or ""], size[t or ""], keep[t or ""] == i) for i, t in rows)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.unhex(F.hex(F.substring(t, 1, 1).cast("binary")))])
def test_exact_dedup_is_brute_force(spark, tmp_path, digest):
    """With a digest that clashes too: the bytes decide."""
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", "a", "A", "ab", "b" * 5000, "b" * 4999, f"own {i}"])) for i in range(60)]
    path = f"{tmp_path}/documents.parquet"
    documents(spark, rows, "digest string").repartition(3).write.parquet(path)
    got = exact_dedup.exact_dedup(spark, path, Workspace(spark, "t"), digest=digest).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == dedup_plain(rows)


def test_exact_dedup_goes_on_with_new_files(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    documents(spark, [(1, "x"), (2, "y"), (2, "y")]).write.parquet(path)
    stream = exact_dedup.DedupStream(spark, Workspace(spark, "t"))
    stream.advance(path, files=1)
    documents(spark, [(9, "x"), (3, "z")]).write.mode("append").parquet(path)
    stream.advance(path, files=1)
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in stream.resolve(path).collect())
    assert got == [(1, 9, 2, False), (2, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (9, 9, 2, True)]


def test_exact_dedup_of_an_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert exact_dedup.op5_exact_dedup(spark, str(tmp_path)).collect() == []


URLS = [
    ("http://a.example.com/en/7", "a.example.com", "/en/7", "example.com/en/7", "allow"),
    ("HTTPS://EXAMPLE.COM/en/81?x#y", "example.com", "/en/81", "com/en/", "block"),
    ("x://net/de/", "net", "/de/", "net/de/", "allow"),
    ("x://a.example.net/de/8#", "a.example.net", "/de/8", "example.net/de/8", "block"),
    ("x://internet/de/8", "internet", "/de/8", None, None),
    ("x://b.org/es/", "b.org", "/es/", "org/es/", "block"),
    ("x://b.org?/es/", "b.org", "", None, None),
    ("no scheme", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("x://É.Org/es/é\nz", "É.org", "/es/é\nz", "org/es/", "block"),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in url_filter.filter_urls(df, Workspace(spark, "t")).collect()}
    assert len(got) == len(URLS)
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert url_filter.filter_urls(df.limit(0), Workspace(spark, "t")).collect() == []


def ratio_plain(url, accepted, rejected):
    def model(urls):
        counts = Counter()
        for u in urls:
            s = "\2" * 3 + u + "\3"
            for i in range(3, len(s)):
                for k in range(4):
                    counts[s[i - k : i + 1]] += 1
        return counts

    def p(counts, gram):
        out = 1 / 256
        for k in range(4):
            g = gram[3 - k :]
            same = {x: c for x, c in counts.items() if len(x) == k + 1 and x[:-1] == g[:-1]}
            n, t = sum(same.values()), len(same)
            out = (same.get(g, 0) + t * out) / (n + t) if n + t else out
        return out

    s, a, r = "\2" * 3 + url + "\3", model(accepted), model(rejected)
    return sum(round((math.log(p(a, s[i - 3 : i + 1])) - math.log(p(r, s[i - 3 : i + 1]))) * 2**20) for i in range(3, len(s))) / (len(s) - 3) / 2**20


def test_url_scores_are_the_markov_models(spark):
    import zlib

    rng = random.Random(2)
    allow = [f"http://good{rng.randrange(9)}.net/de/{rng.randrange(7)}{i}" for i in range(30)]
    block = [f"http://casino{rng.randrange(9)}.com/en/{i}" for i in range(30)]
    other = ["http://casino1.org/fr/1", "http://good.org/fr/2", "http://good.org/fr/2", "zzz"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(allow + block + other)], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(df, Workspace(spark, "t")).collect()}
    held = lambda u: zlib.crc32(u.encode()) % 5 == 0
    for i, u in enumerate(other, 60):
        assert got[i].score == pytest.approx(ratio_plain(u, [x for x in allow if not held(x)], [x for x in block if not held(x)]), abs=2e-6)
    assert got[60].verdict == "block" and got[61].verdict == got[62].verdict == "allow"


def test_quality(spark):
    import zlib

    rng = random.Random(0)
    rows, labels = [], []
    for i in range(300):
        good = i % 4 != 0
        rows.append((i, " ".join(f"{w}{'' if good else rng.choice(['###', '$$$'])}" for w in prose(rng, 60).split())))
        if i % 3:
            labels.append((i, int(good), 0))
    rows += [(1000, None), (1001, ""), (None, "w1x"), (5, rows[5][1])]
    docs = documents(spark, rows, "score string")
    df = spark.createDataFrame(labels + [(2000, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, df)
    got = quality.score_documents(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    right = [r.predicted == int(r.doc_id % 4 != 0) for r in got if r.doc_id is not None and r.doc_id < 300]
    assert sum(right) >= 0.97 * len(right)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_quality_without_rows_or_labels(spark):
    docs, none = documents(spark, [(1, "a")]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [tuple(r)[2:] for r in quality.score_documents(docs, quality.fit(docs, none)).collect()] == [(0.5, 1)]
    assert quality.score_documents(docs.limit(0), quality.fit(docs.limit(0), none)).collect() == []


def test_neighbour_votes_are_brute_force():
    rng = np.random.default_rng(0)
    x, y = rng.poisson(0.3, (80, quality.SIZE)).astype(np.float32), rng.integers(0, 2, 80).astype(float)
    m = quality.Model(np.ones(quality.SIZE, np.float32), rng.standard_normal((quality.SIZE, 8)).astype(np.float32), np.zeros((0, 8)), y, 0.5)
    m.vectors = m.embed(x)
    got = m.score(x[:9])
    for i in range(9):
        cos = m.embed(x[i : i + 1])[0] @ m.vectors.T
        best = np.argsort(-cos)[: quality.NEIGHBOURS]
        w = np.maximum(cos[best], 0).astype(float)
        assert got[i] == pytest.approx((w * y[best]).sum() / w.sum(), abs=1e-5)


def lookup_plain(shards, size):
    prefs = [[(sharding._number(s, "offset") % size + j * (sharding._number(s, "skip") % (size - 1) + 1)) % size for j in range(size)] for s in shards]
    owner = {}
    while len(owner) < size:
        for i, p in enumerate(prefs):
            free = next((x for x in p if x not in owner), None)
            if free is not None:
                owner[free] = i
    return [owner[s] for s in range(size)]


def test_lookup_table():
    for n, size in ((1, 7), (3, 13), (13, 13), (10, 997)):
        names = tuple(f"s{i}" for i in range(n))
        assert sharding.lookup_table(names, size) == lookup_plain(names, size)
    table = sharding.lookup_table(sharding.SHARDS)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    less = sharding.lookup_table(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, less) if a != len(sharding.SHARDS) - 1)
    assert moved < 0.05 * len(table)
    for bad in (((), 7), (("a", "a"), 7), (("a",), 8)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_assign_shards(spark):
    df = documents(spark, [(1, "a"), (1, "b"), (None, "c"), (2, None)], "slot int")
    got = sharding.assign_shards(df, "doc_id").collect()
    owner = sharding.lookup_table(sharding.SHARDS)
    assert len(got) == 4 and all(r.shard == sharding.SHARDS[owner[r.slot]] for r in got)
    assert len({r.shard for r in got if r.doc_id == 1}) == 1
    assert sharding.assign_shards(df.limit(0), "doc_id").collect() == []


def test_equally_named_files_of_two_folders(spark, tmp_path):
    """Rows at the same place of files with the same name are two rows."""
    import shutil

    for folder in ("p=1", "p=2"):
        documents(spark, [(1, "same")]).coalesce(1).write.parquet(f"{tmp_path}/docs/{folder}")
    names = [next((tmp_path / "docs" / f).glob("*.parquet")) for f in ("p=1", "p=2")]
    shutil.move(names[0], names[0].with_name("x.parquet"))
    shutil.move(names[1], names[1].with_name("x.parquet"))
    path = f"{tmp_path}/docs"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = exact_dedup.exact_dedup(spark, path, Workspace(spark, "t")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 1, 2, False), (1, 1, 2, True)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_queries_that_share_an_id_have_ranks_of_their_own(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [-1.0]), (1, [3.0]), (2, [2.0])], "vec_id long, vector array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id = 0"), Workspace(spark, "t"), block=1).collect())
    assert got == [(0, 1, 1, 3), (0, 1, 2, -2), (0, 2, 1, -3), (0, 2, 2, 2)]
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(0, [1e9])], df.schema), df, Workspace(spark, "t"))


def test_columns_named_as_helpers_pass(spark):
    names = ["row", "slot2", "__slot", "__shard", "url", "said", "n", "gram", "key", "drops", "lines", "body", "__id", "__drops", "__kept", "__lines", "__row", "__n", "__said", "holder", "pos"]
    long = "A line that is long enough to be counted"
    df = spark.createDataFrame([(i, f"x://a.fr/{i}", f"{long}\n{i}", *names) for i in range(4)], ", ".join(["doc_id long", "url string", "text string", *[f"{n}_ string" for n in names]]))
    df = df.select("doc_id", "text", *[F.col(f"{n}_").alias(n) if n != "url" else F.col("url") for n in names])
    rest = lambda out: {(r.doc_id, *(r[n] for n in names if n != "url")) for r in out.collect()}
    want = {(i, *(n for n in names if n != "url")) for i in range(4)}
    assert rest(sharding.assign_shards(df, "doc_id")) == want
    assert rest(url_filter.filter_urls(df, Workspace(spark, "t"))) == want
    from quirework.llm import line_dedup

    out = line_dedup.dedup_lines(df, Workspace(spark, "t"))
    assert rest(out) == want and out.columns == [*df.columns, "n_lines", "n_dropped"]
    assert {(r.doc_id, r.text) for r in out.collect()} == {(3, f"{long}\n3"), (2, "2"), (1, "1"), (0, "0")}


def test_very_long_urls_take_linear_time(spark):
    import time

    rows = [(1, "http://x.net/de/" + "ab" * 200), (2, "http://x.com/en/" + "cd" * 200), (3, "http://x.fr/" + "abcd" * 250_000)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    began = time.time()
    got = {r.page_id: r for r in url_filter.filter_urls(df, Workspace(spark, "t")).collect()}
    assert got[3].path == "/" + "abcd" * 250_000 and got[3].score is not None
    assert time.time() - began < 60


def test_url_threshold_is_the_best_cut(spark):
    rows = [(-1.5, "block", 3), (-0.25, "block", 1), (0.5, "allow", 2), (0.75, "block", 1), (2.0, "allow", 4)]
    df = spark.createDataFrame(rows, "score double, verdict string, n long")
    least = url_filter.threshold(df)
    good = lambda t: sum(n for s, v, n in rows if v == "allow" and s >= t) / 6 + sum(n for s, v, n in rows if v == "block" and s < t) / 5
    assert good(least) == max(good(s + d) for s, _, _ in rows for d in (-0.01, 0.01)) and -0.25 < least <= 0.5
    assert url_filter.threshold(df.where("verdict = 'allow'")) == 0 == url_filter.threshold(df.limit(0))


def test_quality_with_an_id_that_many_rows_share(spark):
    docs = documents(spark, [(1, f"word{i} good") for i in range(500)] + [(2, "bad###")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    x, y = quality.labelled_counts(docs, labels, 10)
    assert len(y) == len(x) <= 2


def test_a_workspace_leaves_nothing(spark):
    import os

    with Workspace(spark, "t") as ws:
        ws.put("x", spark.range(3))
        root = ws.root.removeprefix("file:")
        assert os.path.exists(root)
    assert not os.path.exists(root)
