"""Folds over long arrays agree with the ones in the JVM, and take linear time."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.operators import chunking, drawing, folds, tables


@pytest.mark.parametrize("seed", range(4))
def test_long_arrays_are_folded_like_short_ones(spark, seed, monkeypatch):
    rng = random.Random(seed)
    weighed = spark.createDataFrame([(d, i, rng.choice([0, 1, 5, 30, 70])) for d in range(6) for i in range(rng.randrange(1, 90))], "d long, i int, w long")
    placed = spark.createDataFrame([(t, i, "x", float(rng.randrange(9)), rng.choice([0.0, 5.0, 10.0, 10.5, 15.0, rng.random() * 40]), 1.0, 1.0) for t in range(6) for i in range(rng.randrange(1, 60))], "table_id long, pos long, text string, x0 double, y0 double, x1 double, y1 double")
    ops = [(*folds.OPS, "q")[rng.randrange(12)] for _ in range(1200)]
    args = {"Tm": 6, "Td": 2, "TD": 2, "TL": 1, '"': 3}
    stream = [(o, [float(rng.randrange(-4, 9)) for _ in range(args.get(o, 0) if rng.random() < 0.9 else 0)]) for o in ops]
    boxes = [tuple(float(v) for v in (x, y, x + 3, y + 4)) for x, y in [(rng.randrange(-9, 9), rng.randrange(-9, 9)) for _ in range(4)]]
    pages = spark.createDataFrame([(1, p, [("BT", []), *stream[p * 200 : p * 200 + 200]], [*boxes, None][p % 2 :]) for p in range(6)] + [(1, 9, [("Tj", [])], [])], "doc_id long, page_number int, ops array<struct<op: string, args: array<double>>>, boxes array<struct<x0: double, y0: double, x1: double, y1: double>>")
    made = []
    for large in (10_000, 0):
        monkeypatch.setattr(folds, "LARGE", large)
        made.append([sorted(map(str, df.collect())) for df in (chunking.by_weight(weighed, ["d"], "i", "w", 100, 7), tables.cluster_rows(placed), drawing.edit_stream(pages))])
    assert made[0] == made[1]


def took(f):
    began = time.monotonic()
    f()
    return time.monotonic() - began


def test_a_million_rows_in_a_group(spark):
    """Texts of one document, and objects of one table."""
    texts = spark.range(1_000_000).select(F.lit(1).alias("d"), F.col("id").alias("i"), (F.col("id") % 97).alias("w"))
    assert took(lambda: chunking.by_weight(texts, ["d"], "i", "w", 1500, 20).agg(F.max("chunk")).collect()) < 10
    objects = spark.range(300_000).select(F.lit("t").alias("table_id"), F.col("id").alias("pos"), F.lit("x").alias("text"), (F.col("id") % 9 * 50).cast("double").alias("x0"), (-F.col("id").cast("double")).alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"))
    assert took(lambda: tables.cluster_rows(objects).agg(F.max("row")).collect()) < 20


def test_a_million_operations_on_a_page(spark):
    one = "array(named_struct('op', 'Tm', 'args', array(1D, 0D, 0D, 1D, CAST(i % 500 AS DOUBLE), CAST(i AS DOUBLE))), named_struct('op', 'Tj', 'args', CAST(array() AS ARRAY<DOUBLE>)))"
    page = spark.range(1).select(F.lit(1).alias("doc_id"), F.lit(0).alias("page_number"), F.expr(f"concat(array(named_struct('op', 'BT', 'args', CAST(array() AS ARRAY<DOUBLE>))), flatten(transform(sequence(1, 500000), i -> {one})))").alias("ops"), F.expr("transform(sequence(0, 9), b -> named_struct('x0', b*50D, 'y0', 0D, 'x1', b*50D+4, 'y1', 1e6D))").alias("boxes"))
    seen = []
    assert took(lambda: seen.append(drawing.edit_stream(page).select(F.size("ops")).first()[0])) < 10
    hit = sum(any(b * 50 - 0.5 <= i % 500 <= b * 50 + 4.5 for b in range(10)) for i in range(1, 500_001))
    assert seen == [1_000_001 - hit]


def test_rows_at_the_edge_of_the_tolerance():
    ys = np.array([0.3, 0.1 + 0.2, 0.2, 0.1, 0.0, -4.7, -4.7000000001, -5.0])
    want, anchor, row = [], None, -1
    for y in ys:
        if anchor is None or abs(y - anchor) > 5.0:
            anchor, row = y, row + 1
        want.append(row)
    assert folds.row_numbers(ys, 5.0).tolist() == want
    assert folds.row_numbers(np.array([9.0, np.nan, 1.0]), 5.0).tolist() == [0, 0, 1]
