"""Joins of boxes by tiles find what comparing all boxes of a page does."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quirework.operators import match, spatial, tables

BOX = "x0 double, y0 double, x1 double, y1 double"


def boxes(rng, n, most):
    out = []
    for _ in range(n):
        x, y = rng.choice([0.0, 50.0, rng.random() * 100]), rng.choice([0.0, 25.0, rng.random() * 100])
        out.append((x, y, x + rng.choice([0.0, 5.0, rng.random() * most]), y + rng.choice([0.0, 5.0, rng.random() * most])))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_tiles_find_what_all_pairs_do(spark, seed, monkeypatch):
    rng = random.Random(seed)
    pages = [(d, p) for d in range(2) for p in range(2)]
    inner = spark.createDataFrame([(d, p, f"o{i}", i, "t", *b) for d, p in pages for i, b in enumerate(boxes(rng, 60, 20))], f"doc_id long, page_number int, id string, pos long, text string, {BOX}")
    outer = spark.createDataFrame([(d, p, f"b{i}", "text", 0.5, i, *b) for d, p in pages for i, b in enumerate([*boxes(rng, 40, 40), (-500.0, -500.0, 900.0, 900.0)][: 41 - 41 * d * p])], f"doc_id long, page_number int, block_id string, raw_category string, confidence double, block_pos long, {BOX}")
    points = inner.select("doc_id", "page_number", "id", F.col("x0").alias("x"), F.col("y0").alias("y"))
    small = outer.where("block_id <> 'b40'")
    made = []
    for limit in (1 << 40, 500):
        monkeypatch.setattr(spatial.page_join, "__defaults__", ("inner", 0.0, limit, False))
        pairs = match.containment_pairs(inner, outer, 0.3).select("p.doc_id", "p.page_number", "p.id", "b.block_id", "containment")
        held = tables.objects_in_tables(inner, outer)
        made.append([sorted(map(str, df.collect())) for df in (pairs, held, match.uncovered(points, small), match.assign_categories(inner, outer))])
    assert made[0] == made[1] and all(made[0])


def test_a_crowded_page(spark):
    """10^5 objects and 10^4 blocks on one page."""
    objects = spark.range(100_000).selectExpr("1L AS doc_id", "0 AS page_number", "CAST(id AS STRING) AS id", "(id % 1000) * 10D AS x0", "(id div 1000) * 10D AS y0", "(id % 1000) * 10D + 8 AS x1", "(id div 1000) * 10D + 8 AS y1")
    blocks = spark.range(10_000).selectExpr("1L AS doc_id", "0 AS page_number", "CAST(id AS STRING) AS block_id", "'text' AS raw_category", "0.5D AS confidence", "id AS block_pos", "(id % 500) * 20D AS x0", "(id div 500) * 50D AS y0", "(id % 500) * 20D + 19 AS x1", "(id div 500) * 50D + 49 AS y1")
    began = time.monotonic()
    found = match.assign_categories(objects, blocks).where("layout_block_id IS NOT NULL")
    n, right = found.count(), found.where("layout_block_id = CAST((CAST(x0 AS LONG) div 20) + (CAST(y0 AS LONG) div 50) * 500 AS STRING)").count()
    assert n == right == 100_000 and time.monotonic() - began < 40  # two runs
