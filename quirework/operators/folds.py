"""Ordered folds over arrays of any length.

Spark's aggregate copies the array that a fold collects at each step, which is quick for the tens of rows that a page or
table usually has and quadratic beyond. The functions here do the same folds in one pass over Arrow arrays; ``routed``
sends only arrays of more than LARGE elements to them, so that usual rows stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements up to which a fold stays in the JVM.
LARGE = 512


def routed(usual: Column, size: Column, large: Callable, *arrays: Column) -> Column:
    """``usual`` where ``size`` is at most LARGE, else ``large`` of ``arrays``: Python gets nulls in place of the others."""
    big = size > LARGE
    return F.when(big, large(*[F.when(big, a) for a in arrays])).otherwise(F.when(~big, usual))


def _lists(column: pa.Array) -> list[np.ndarray | None]:
    """The lists of a column as arrays; null elements of numbers become NaN or, of whole numbers, 0."""
    flat = column.values
    values = flat.fill_null(float("nan") if pa.types.is_floating(flat.type) else 0).to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy()
    valid = column.is_valid().to_pylist()
    return [values[a:b] if ok else None for a, b, ok in zip(ends, ends[1:], valid)]


def _made(lists: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    sizes = np.cumsum([0] + [0 if x is None else len(x) for x in lists]).astype(np.int32)
    some = [x for x in lists if x is not None]
    values = pa.array(np.concatenate(some) if some else [], kind)
    mask = pa.array([x is None for x in lists])
    return pa.ListArray.from_arrays(pa.array(sizes), values, mask=mask)


def chunk_numbers(weights: np.ndarray, most: int, count: int) -> np.ndarray:
    """The chunk of each weight: a chunk ends before the one that would be one too many or too heavy. Each chunk's end is
    found in the weights' prefix sums."""
    n = len(weights)
    sums = np.concatenate([[0], np.cumsum(weights, dtype=np.int64)])
    starts, i = [0], 0
    while True:
        # the first place whose weight no longer fits; the first weight of a chunk always does
        i = max(i + 1, min(i + count, int(np.searchsorted(sums, sums[i] + most, side="right")) - 1))
        if i >= n:
            break
        starts.append(i)
    marks = np.zeros(n, np.int32)
    marks[starts[1:]] = 1
    return np.cumsum(marks, dtype=np.int32)


def chunks(most: int, count: int) -> Callable:
    @F.arrow_udf("array<int>")
    def large(weights: pa.Array) -> pa.Array:
        return _made([None if w is None else chunk_numbers(w, most, count) for w in _lists(weights)], pa.int32())

    return large


def row_numbers(y: np.ndarray, tolerance: float) -> np.ndarray:
    """The row of each y (in descending order): a row takes what lies within the tolerance of its first one. A y that is
    unknown stays in the row before it."""
    out = np.zeros(len(y), np.int32)
    known = np.flatnonzero(~np.isnan(y))
    ys, n = y[known], len(known)
    marks = np.zeros(len(y), np.int32)
    i = 0
    while i < n:
        # the last one within the tolerance, by search; the difference itself decides at its edge
        j = max(i + 1, int(np.searchsorted(-ys, -(ys[i] - tolerance), side="right")) - 1)
        while j > i + 1 and abs(ys[j - 1] - ys[i]) > tolerance:
            j -= 1
        while j < n and abs(ys[j] - ys[i]) <= tolerance:
            j += 1
        if j < n:
            marks[known[j]] = 1
        i = j
    np.cumsum(marks, out=out)
    return out


def rows(tolerance: float) -> Callable:
    @F.arrow_udf("array<int>")
    def large(y: pa.Array) -> pa.Array:
        return _made([None if v is None else row_numbers(v, tolerance) for v in _lists(y)], pa.int32())

    return large


#: Operations of a content stream that the fold tells apart, by code from 1 on.
OPS = ("BT", "ET", "Tm", "Td", "TD", "T*", "'", '"', "TL", "Tj", "TJ")
#: What becomes of an operation.
KEEP, DROP, NEXT_LINE, SPACED_NEXT_LINE = 0, 1, 2, 3


def stream_actions(ops: np.ndarray, sizes: np.ndarray, args: np.ndarray, boxes: np.ndarray, tolerance: float) -> np.ndarray:
    """What becomes of each operation (:data:`OPS`, 0 for others). ``args``: the first six arguments of each, ``boxes``: x0,
    y0, x1, y1 of each. One pass finds the place of each shown text, one comparison by blocks which places are covered."""
    code = {name: i + 1 for i, name in enumerate(OPS)}
    bt, et, tm, td, td2, star, quote, quotes, tl, show, show2 = (code[n] for n in OPS)
    inside, x, y, lead = False, 0.0, 0.0, 0.0
    at, px, py = [], [], []
    for i, (op, n, a) in enumerate(zip(ops.tolist(), sizes.tolist(), args.tolist())):
        if inside and op in (show, show2, quote, quotes):
            at.append(i), px.append(x), py.append(y if op in (show, show2) else y - lead)
        if op == bt:
            inside, x, y = True, 0.0, 0.0
        elif op == et:
            inside = False
        elif inside:
            if op == tm and n >= 6:
                x, y = a[4], a[5]
            elif op in (td, td2) and n >= 2:
                x, y = x + a[0], y + a[1]
                if op == td2:
                    lead = -a[1]
            elif op == tl and n >= 1:
                lead = a[0]
            elif op in (star, quote, quotes):
                y -= lead
    out = np.zeros(len(ops), np.int32)
    if not at or not len(boxes):
        return out
    at, px, py = np.array(at), np.array(px), np.array(py)
    lo_x, lo_y, hi_x, hi_y = boxes[:, 0] - tolerance, boxes[:, 1] - tolerance, boxes[:, 2] + tolerance, boxes[:, 3] + tolerance
    block = max(1, (1 << 22) // len(boxes))
    for i in range(0, len(at), block):
        s = slice(i, i + block)
        u, v = px[s, None], py[s, None]
        hit = at[s][((u >= lo_x) & (u <= hi_x) & (v >= lo_y) & (v <= hi_y)).any(axis=1)]
        out[hit] = np.where(ops[hit] == quote, NEXT_LINE, np.where(ops[hit] == quotes, np.where(sizes[hit] >= 2, SPACED_NEXT_LINE, NEXT_LINE), DROP))
    return out


def stream(tolerance: float) -> Callable:
    @F.arrow_udf("array<int>")
    def large(ops: pa.Array, sizes: pa.Array, args: pa.Array, boxes: pa.Array) -> pa.Array:
        found = []
        for o, n, a, b in zip(_lists(ops), _lists(sizes), _lists(args), _lists(boxes)):
            found.append(None if o is None else stream_actions(o, n, a.reshape(-1, 6), np.empty((0, 4)) if b is None else b.reshape(-1, 4), tolerance))
        return _made(found, pa.int32())

    return large.asNondeterministic()  # its answer is used twice: it is not to be asked for twice
