import random

import corpus_pipeline
from quirework.llm import packing
from quirework.llm.workspace import Workspace

from .helpers import DOCS, components, deduped_lines, prose, shingles


def test_stages_are_brute_force(spark, tmp_path):
    rng = random.Random(4)
    line = "A line that is long enough and in many documents"
    rows = []
    for i in range(80):
        text = prose(rng, 60, 2000)
        if i % 5 == 0:
            text = " ".join(w + "###" for w in text.split())
        elif i % 5 == 1:
            text += "\n" + line
        elif i % 5 == 2 and rows:
            text = rows[-1][1] + " tail"
        rows.append((i, text))
    rows += [(80, None), (81, ""), (82, line)]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, ws, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), Workspace(spark, "t"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = ws.put(name.replace(" ", "-"), stage(spark, docs, str(tmp_path)))
        assert out.columns == docs.columns
        seen.append({r.doc_id: r for r in out.collect()})
        docs = out
    good = {i for i, t in rows if "###" not in (t or "")}
    assert set(seen[0]) == good
    want = {i: t for i, _, t in deduped_lines([r for r in rows if r[0] in good])}
    assert {i: r.text for i, r in seen[1].items()} == want and all(r.n_chars == len(r.text) for r in seen[1].values())
    own = components({i: shingles(t) for i, t in want.items()})
    assert set(seen[2]) == {i for i in want if own[i] == i}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(seen[2]) and packed[0].asDict().keys() == {c.split()[0] for c in packing.PACKED.split(", ")}


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} <= {q.split("_")[0] for q in names}


def test_stages_with_odd_rows(spark, tmp_path):
    """Empty tables, repeated rows, null ids and texts, and columns with the operators' own names."""
    line = "A line that is long enough and in many documents"
    text = prose(random.Random(9), 40, 500)
    rows = [(1, text), (1, text), (1, line), (2, f"{line}\nx"), (None, line), (None, None), (3, ""), (4, text), (5, f"y\n{line}")]
    extra = "n_lines int, row string, __id string, h long, d long, lines string, score double"
    docs = spark.createDataFrame([(i, t, "en", "s", *[None] * 7) for i, t in rows], f"doc_id long, text string, lang string, source string, {extra}")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.collect() == [] and (name == "packing" or empty.columns == docs.columns)
        ws = Workspace(spark, "t")
        seen = ws.put(f"s{i}", stage(spark, seen, str(tmp_path)))
        got = sorted((str(r.doc_id), getattr(r, "text", None) or "") for r in seen.collect())
        if i == 0:
            assert len(got) == len(rows)
        if i == 1:
            kept = sorted([("1", text), ("1", text), ("1", ""), ("2", "x"), ("None", ""), ("None", ""), ("3", ""), ("4", text), ("5", f"y\n{line}")])
            assert got == kept
        if i == 2:
            assert got == sorted([("1", text), ("1", ""), ("2", "x"), ("None", ""), ("None", ""), ("3", ""), ("5", f"y\n{line}")])
    assert sorted(str(r.doc_id) for r in seen.collect()) == ["1", "1", "2", "3", "5", "None", "None"]
