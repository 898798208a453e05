"""Exact nearest rows of stated queries, in cells of bounded size.

Products of a cell's queries and rows come from one matrix product. It is summed in another order than Spark sums, so it only
tells which rows can be among the nearest: all whose value lies within what rounding to nine digits and the product's own error
can shift. These are scored again by sums in Spark's order, so that scores and ties are those of ``functions/vector.py``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvina.operators.similar import _cells

#: Products, and pairs scored again, that are held at a time.
AT_ONCE = 4_000_000


def nearest_in_cells(held: DataFrame, asked: DataFrame, parts: int, k: int, metric: str, with_null: bool, within: float | None = None) -> DataFrame:
    """(query_id, id, score) of what can be among the nearest k in each cell, of held (cell, id, v) and asked (cell, query_id, v).

    With ``within``, only rows at a smaller Euclidean distance from the query count; vectors are then finite and of one length,
    and the metric is COSINE.
    """
    ids, asks = held.schema["id"].dataType, asked.schema["query_id"].dataType
    kind = "array<float>" if {x.schema["v"].dataType.simpleString() for x in (held, asked)} == {"array<float>"} else "array<double>"
    one = held.select(F.col("cell").cast("long").alias("cell"), F.lit(False).alias("is_query"), F.lit(None).cast(asks).alias("query_id"), "id", F.col("v").cast(kind).alias("v"))
    two = asked.select(F.col("cell").cast("long").alias("cell"), F.lit(True).alias("is_query"), "query_id", F.lit(None).cast(ids).alias("id"), F.col("v").cast(kind).alias("v"))
    cells = one.unionByName(two).repartition(parts, "cell").sortWithinPartitions("cell")
    out = T.StructType([T.StructField("query_id", asks), T.StructField("id", ids), T.StructField("score", T.DoubleType())])
    return cells.mapInArrow(_nearest(k, metric, with_null, within), out)


class _Vectors:
    """Lengths (-1: null, or with null components) and components of a list column."""

    def __init__(self, column: pa.ChunkedArray):
        lists = column.combine_chunks()
        values = lists.flatten()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(sizes) - sizes
        self.size = np.where(lists.is_null().to_numpy(zero_copy_only=False), -1, sizes)
        self.size[np.repeat(np.arange(len(sizes)), sizes)[values.is_null().to_numpy(zero_copy_only=False)]] = -1
        self.values = values.to_numpy(zero_copy_only=False).astype(np.float64)

    def of(self, rows: np.ndarray, size: int) -> np.ndarray:
        return self.values[self.start[rows][:, None] + np.arange(size)]


def _in_order(columns: Iterator[np.ndarray], n: int) -> np.ndarray:
    total = np.zeros(n)
    for c in columns:
        total = total + c
    return total


def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt(_in_order((v[:, d] * v[:, d] for d in range(v.shape[1])), len(v)))


def _scores(q: np.ndarray, r: np.ndarray, nq: np.ndarray, nr: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """Scores of pairs (i, j); q and r hold a row for each dimension."""
    if metric == "L2":
        return 1 / (1 + _distances(q, r, i, j))
    dot = _in_order((q[d][i] * r[d][j] for d in range(len(q))), len(i))
    if metric == "IP":
        return dot
    n = nq[i] * nr[j]
    return np.where(n == 0, 0.0, dot / np.where(n == 0, 1.0, n))


def _distances(q: np.ndarray, r: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.sqrt(_in_order(((a := q[d][i] - r[d][j]) * a for d in range(len(q))), len(i)))


def _close(q: np.ndarray, r: np.ndarray, nq: np.ndarray, nr: np.ndarray, k: int, within: float) -> np.ndarray:
    """For each unit row of q, which unit rows of r can be among its nearest k by cosine of those at a distance below ``within``."""
    near = q @ r.T
    far = nq[:, None] ** 2 + nr**2
    gap, slack = far - 2 * near * nq[:, None] * nr - within**2, 1e-12 * (far + within**2)
    can = ~(gap > slack)  # also where it isn't a number
    if len(r) > k:
        sure = np.where(gap < -slack, near, -np.inf)
        least = np.partition(sure, len(r) - k, axis=1)[:, len(r) - k]
        can &= ~(near < least[:, None] - 3e-9)
    return can


def _candidates(q: np.ndarray, r: np.ndarray, nq: np.ndarray, nr: np.ndarray, k: int, metric: str) -> np.ndarray:
    """For each row of q, which rows of r can be among its nearest k; vectors that aren't finite always can."""
    if len(r) <= k:
        return np.ones((len(q), len(r)), dtype=bool)
    sound, asks = np.isfinite(nr), np.isfinite(nq)
    near, far = q @ r.T, nr[sound].max(initial=0)
    if metric == "L2":
        near = 2 * near - (nq**2)[:, None] - nr**2
    near[:, ~sound], near[~asks] = -np.inf, -np.inf
    least = np.partition(near, len(r) - k, axis=1)[:, len(r) - k]
    if metric == "COSINE":
        least = least - 3e-9
    elif metric == "IP":
        least = least - 3e-9 - 1e-12 * nq * far
    else:
        slack = 1e-12 * (nq**2 + far**2)
        d = np.sqrt(np.maximum(slack - least, 0))
        least = -((d + 4e-9 * (1 + d) ** 2) ** 2) - slack
    return (near >= np.where(asks, least, -np.inf)[:, None]) | ~sound


def _few(i: np.ndarray, j: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Of equally near rows of a query the first k."""
    bits = score.view(np.int64)
    order = np.lexsort((place[j], bits, i))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(i[order]) != 0) | (bits[order][1:] != bits[order][:-1])
    nth = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return order[nth < k]


def _nearest(k: int, metric: str, with_null: bool, within: float | None):
    """From batches (cell, is_query, query_id, id, v), sorted by cell, to (query_id, id, score) that hold each query's nearest k in the cell.

    Pairs with a null vector, a null component or different lengths have a null score and come after all others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(batches):
            asks = t.column("is_query").combine_chunks()
            asked, held = t.filter(asks), t.filter(pc.invert(asks))
            if not asked.num_rows or not held.num_rows:
                continue
            q, r = _Vectors(asked.column("v")), _Vectors(held.column("v"))
            ids, query_ids = held.column("id").combine_chunks(), asked.column("query_id").combine_chunks()
            place = np.empty(len(ids), dtype=np.int64)
            place[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
            with np.errstate(all="ignore"):
                for i, j, score in _cell(q, r, place, k, metric, with_null, within):
                    yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(i)), ids.take(pa.array(j)), score], names=["query_id", "id", "score"])

    return run


def _cell(q: _Vectors, r: _Vectors, place: np.ndarray, k: int, metric: str, with_null: bool, within: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    by_size = {n: np.flatnonzero(r.size == n) for n in np.unique(r.size).tolist() if n >= 0}
    norms = np.full(len(place), np.nan)
    for size, rows in by_size.items():
        norms[rows] = _norms(r.of(rows, size))
    for size in np.unique(q.size).tolist():
        asked, rows = np.flatnonzero(q.size == size), by_size.get(size, np.empty(0, dtype=np.int64))
        nq = _norms(q.of(asked, size)) if size >= 0 else np.full(len(asked), np.nan)
        if len(rows) < len(place):
            yield from _others(asked, nq, rows, norms, place, k, metric, with_null)
        if not len(rows):
            continue
        v, nr = r.of(rows, size), norms[rows]
        unit = v / np.where(nr == 0, 1.0, nr)[:, None] if metric == "COSINE" else v
        by_row = np.ascontiguousarray(v.T)
        step = max(1, AT_ONCE // len(rows))
        for at in range(0, len(asked), step):
            some, n = asked[at : at + step], nq[at : at + step]
            w = q.of(some, size)
            own = w / np.where(n == 0, 1.0, n)[:, None] if metric == "COSINE" else w
            i, j = np.nonzero(_candidates(own, unit, n, nr, k, metric) if within is None else _close(own, unit, n, nr, k, within))
            by_query = np.ascontiguousarray(w.T)
            if within is not None:
                inside = _distances(by_query, by_row, i, j) < within
                i, j = i[inside], j[inside]
            score = _scores(by_query, by_row, n, nr, i, j, metric)
            kept = _few(i, j, score, place[rows], k)
            yield some[i[kept]], rows[j[kept]], pa.array(score[kept])


def _others(asked: np.ndarray, nq: np.ndarray, rows: np.ndarray, norms: np.ndarray, place: np.ndarray, k: int, metric: str, with_null: bool):
    """Queries with the rows that have no such length: cosines are 0 where a norm is 0, all else is null; the first k of each."""
    other = np.setdiff1d(np.arange(len(place)), rows)
    other = other[np.argsort(place[other])]
    kinds = [(nq == 0, np.isfinite(norms[other])), ((nq != 0) & np.isfinite(nq), norms[other] == 0), (~np.isfinite(nq), np.zeros(len(other), dtype=bool))]
    for which, zero in kinds:
        if metric != "COSINE":
            zero = np.zeros(len(other), dtype=bool)
        tied, empty = other[zero][:k], other[~zero][: k if with_null else 0]
        some = asked[which]
        yield np.repeat(some, len(tied)), np.tile(tied, len(some)), pa.array(np.zeros(len(some) * len(tied)))
        yield np.repeat(some, len(empty)), np.tile(empty, len(some)), pa.nulls(len(some) * len(empty), pa.float64())
