"""Approximate nearest neighbours over several shifted Hilbert orderings.

Each ordering projects the vectors on random orthogonal directions, shifts and quantises the projections, and sorts by
the Hilbert key of the cell. A sample's quantiles cut the key range into windows of about equal numbers of rows; rows are
dealt to Spark groups by (ordering, window, block), so that a window of any size is many bounded groups. A query visits
its own window and ``reach`` windows to either side in every ordering; candidates are reranked by their exact inner
product in double precision and merged.

``reach`` is fitted on the bounded sample: the smallest for which sampled queries keep ``recall`` of their true
neighbours by inner product in the sample. Vectors without structure need wide windows, clustered ones narrow ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.llm.common import bounded_sample, group_slices, whole_groups
from corvina.llm.vectors import matrix, usable

SAMPLE, ORDERINGS, DIMS, BITS, BLOCK = 4_096, 6, 6, 8, 2_000
#: Rows of a window, and the most windows that the sample's quantiles can tell apart; beyond, windows grow and have more blocks.
WINDOW_ROWS, MOST_WINDOWS = 1_000, 1_024


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert indices of integer points (rows), by Skilling's transposition."""
    x = cells.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """The orderings: directions, shifts, scales and the windows' bounds, all from a bounded sample."""

    def __init__(self, sample: np.ndarray, orderings: int, dims: int, bits: int, windows: int, seed: int):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.bits, self.parts = bits, []
        for _ in range(orderings):
            q, _ = np.linalg.qr(rng.standard_normal((d, min(dims, d))))
            y = sample @ q
            low, high = np.quantile(y, [0.001, 0.999], axis=0)
            span = np.maximum(high - low, 1e-12) * 1.5
            start = low - span * rng.uniform(0, 1 / 3, size=len(span))  # the shift
            self.parts.append((q, start, span))
        self.bounds = [np.unique(np.quantile(k, np.arange(1, windows) / windows, method="nearest")) for k in self.keys(sample)]

    def keys(self, x: np.ndarray) -> list[np.ndarray]:
        side = 1 << self.bits
        return [hilbert_keys(np.clip(np.floor((x @ q - start) / span * side), 0, side - 1), self.bits) for q, start, span in self.parts]

    def windows(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, k, side="right") for b, k in zip(self.bounds, self.keys(x), strict=True)], axis=1)

    def fit_reach(self, sample: np.ndarray, keyed: np.ndarray, k: int, recall: float) -> int:
        """For neighbours by the inner products of ``sample``; ``keyed`` are the same vectors as the keys see them."""
        asks = np.arange(0, len(sample), max(1, len(sample) // 400))
        s = sample[asks] @ sample.T
        s[np.arange(len(asks)), asks] = -np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return 0
        true = np.argpartition(-s, k - 1, axis=1)[:, :k]
        w = self.windows(keyed)
        gap = np.abs(w[asks][:, None, :] - w[true]).min(axis=2)
        for reach in range(max(len(b) for b in self.bounds) + 1):
            if (gap <= reach).mean() >= recall:
                return reach
        return max(len(b) for b in self.bounds) + 1


def _scale(x: np.ndarray) -> np.ndarray:
    """For the keys only: unit length, so that windows follow directions."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(curves: Curves):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = curves.windows(_scale(matrix(b.column("vector")))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vector"), lists], names=["id", "vector", "windows"])

    return run


def _rerank(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "gid"):
            gid, ask, ids = (t.column(c).to_numpy() for c in ("gid", "ask", "id"))
            x = matrix(t.column("vector"))
            for lo, hi in group_slices(gid):
                cut = lo + int(np.searchsorted(ask[lo:hi], 1))
                if cut in (lo, hi):
                    continue
                held, held_ids = x[lo:cut], ids[lo:cut]
                order = np.argsort(held_ids, kind="stable")
                held, held_ids = held[order], held_ids[order]
                for at in range(cut, hi, 1_000):
                    q = ids[at : min(hi, at + 1_000)]
                    s = x[at : at + len(q)] @ held.T
                    s[q[:, None] == held_ids[None, :]] = -np.inf
                    n = min(k, s.shape[1])
                    # keep all that may tie with the n-th, then the smaller ids among them
                    floor = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
                    slack = 1e-9 * np.maximum(np.abs(floor), 1e-300)
                    i, j = np.nonzero((s >= (floor - slack)[:, None]) & (s > -np.inf))
                    # summed in one order, so that a pair has the same score in whatever group
                    score = np.einsum("ij,ij->i", x[at : at + len(q)][i], held[j])
                    order = np.lexsort((j, -score, i))
                    i, j, score = i[order], j[order], score[order]
                    rank = np.arange(len(i)) - np.searchsorted(i, i, side="left")
                    top = rank < n
                    yield pa.RecordBatch.from_arrays([pa.array(q[i[top]]), pa.array(held_ids[j[top]]), pa.array(score[top])], names=["query_id", "id", "score"])

    return run


def search(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, recall: float = 0.95,
    orderings: int = ORDERINGS, windows: int | None = None, seed: int = 17,
) -> DataFrame:
    """Rows (query_id, rank, id, score): the ``k`` largest inner products for each row whose id is divisible by ``every``.

    All other rows are candidates. Equal scores are ranked by smaller id. Null and zero vectors, vectors with null or
    non-finite components and those not of the commonest length take no part. Of rows that repeat an id the smallest
    vector takes part. An empty table, or a single vector, gives an empty result. Only the two named columns are read.
    """
    spark = vectors.sparkSession
    good = usable(vectors, id_col, vector_col).groupBy("id").agg(F.min("vector").alias("vector"))
    sample = np.array([r[0] for r in bounded_sample(good.select("vector", "id"), SAMPLE, "id")], dtype=np.float64)
    if len(sample) < 2:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    if windows is None:
        windows = min(MOST_WINDOWS, max(32, -(-good.count() // WINDOW_ROWS)))
    keyed = _scale(sample)
    curves = Curves(keyed, orderings, DIMS, BITS, windows, seed)
    reach = curves.fit_reach(sample, keyed, k, recall)
    placed = good.mapInArrow(_assign(curves), "id long, vector array<double>, windows array<int>")
    spots = placed.select("id", "vector", F.posexplode("windows").alias("curve", "window"))
    # no more numbers than orderings times windows
    sizes = {(r[0], r[1]): r[2] for r in spots.groupBy("curve", "window").count().collect()}
    cuts = [x for (c, w), n in sorted(sizes.items()) for x in (c * 10_000 + w, -(-n // BLOCK))]
    blocks = F.create_map(*[F.lit(x) for x in cuts])[F.col("curve") * 10_000 + F.col("window")]
    held = spots.select("id", "vector", "curve", "window", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), F.lit(0).alias("ask"))
    asks = spots.where(F.col("id") % every == 0).select("id", "vector", "curve", F.explode(F.sequence(F.col("window") - reach, F.col("window") + reach)).alias("window"))
    asks = asks.select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(1).alias("ask"))  # a window without rows has no blocks
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    groups = held.unionByName(asks).select("id", "vector", "ask", F.xxhash64("curve", "window", "block").alias("gid"))
    found = groups.repartition(n, "gid").sortWithinPartitions("gid", "ask").mapInArrow(_rerank(k), "query_id long, id long, score double")
    once = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
