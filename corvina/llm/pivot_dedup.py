"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order of nearness. Pivots are vectors of a bounded
sample, so many that an inverted list holds about LIST vectors (between 64 and MOST_PIVOTS), and none links to another:
a dense group has one pivot of its own, which all its members share, however much of the sample it fills. Each vector enters the
inverted lists of its nearest pivots. Vectors that meet in a list are candidates; where two share at least ``shared``
pivots (and only in the list of the first pivot that both have, so each pair counts once), their cosine is computed in
double precision on the original vectors. Equal vectors are merged before, so copies cost one row.

A long list is cut into blocks; every pair of its blocks is a group of bounded size. A group returns sums of links and a
spanning forest, never all pairs. Pivots that stand for most of the sample come first, so that the pairs of a dense group
are compared in its own list and passed over in the others that its members share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import bounded_sample, group_slices, whole_groups
from corvina.llm.vectors import matrix, usable
from corvina.operators.components import connected_components, forest
from corvina.session import saved

LIST, MOST_PIVOTS, BLOCK = 400, 2048, 1_000
#: Sampled vectors for each pivot wanted.
SPARE = 4


def spread(sample: np.ndarray, most: int, least: float) -> np.ndarray:
    """At most so many of the sample's vectors, none with a cosine of ``least`` to one before; those that stand for most come first."""
    unit = _unit(sample)
    chosen, times = np.zeros(most, dtype=np.int64), np.zeros(most, dtype=np.int64)
    taken, n = np.empty((most, unit.shape[1])), 0
    for row, v in enumerate(unit):
        near = taken[:n] @ v
        at = int(near.argmax()) if n else 0
        if n and near[at] >= least:
            times[at] += 1
        elif n < most:
            chosen[n], taken[n], n = row, v, n + 1
    return sample[chosen[np.argsort(-times[:n], kind="stable")]]


def _describe(pivots: np.ndarray, nearest: int):
    unit = (pivots / np.linalg.norm(pivots, axis=1, keepdims=True)).astype(np.float32)
    k = min(nearest, len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("vector"))
            x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            out = np.empty((len(x), k), dtype=np.int32)
            for at in range(0, len(x), 2_000):
                s = x[at : at + 2_000] @ unit.T
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                order = np.argsort(-np.take_along_axis(s, top, axis=1), axis=1, kind="stable")
                out[at : at + 2_000] = np.take_along_axis(top, order, axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, k, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("copies"), b.column("vector"), lists], names=["rep", "copies", "vector", "pivots"])

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _compare(least: float, shared: int, n_pivots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "gid"):
            gid, side, pivot, rep, copies = (t.column(c).to_numpy() for c in ("gid", "side", "pivot", "rep", "copies"))
            x, perms = _unit(matrix(t.column("vector"))), matrix(t.column("pivots"))
            a, b, na, nb = [], [], [], []
            for lo, hi in group_slices(gid):
                if hi - lo < 2:
                    continue
                cut = lo + int(np.searchsorted(side[lo:hi], 1))
                # side 0 against itself where the group is one block (no side 1), else side 0 against side 1
                p, q = (slice(lo, hi), slice(lo, hi)) if cut == hi else (slice(lo, cut), slice(cut, hi))
                if p.stop == p.start:
                    continue
                # two rows that share an earlier pivot meet in its list: those of the commonest earlier pivot pass each other over
                earlier = perms[lo:hi][perms[lo:hi] < pivot[lo]]
                has = (perms[lo:hi] == np.bincount(earlier).argmax()).any(axis=1) if len(earlier) else np.zeros(hi - lo, dtype=bool)
                rest = np.flatnonzero(~has[p.start - lo : p.stop - lo]) + p.start
                i, j = np.nonzero(x[rest] @ x[q].T >= least - 1e-9)
                i, j = rest[i], j + q.start
                if cut == hi:
                    keep = (i < j) | has[j - lo]
                    i, j = i[keep], j[keep]
                else:
                    own, other = np.flatnonzero(has[: cut - lo]) + lo, np.flatnonzero(~has[cut - lo :]) + cut
                    more_i, more_j = np.nonzero(x[own] @ x[other].T >= least - 1e-9)
                    i, j = np.concatenate([i, own[more_i]]), np.concatenate([j, other[more_j]])
                if not len(i):
                    continue
                for at in range(0, len(i), 100_000):
                    ii, jj = i[at : at + 100_000], j[at : at + 100_000]
                    same = perms[ii][:, :, None] == perms[jj][:, None, :]
                    first = np.where(same.any(axis=2), perms[ii], n_pivots).min(axis=1)
                    cos = np.einsum("ij,ij->i", x[ii], x[jj])
                    ok = (same.sum(axis=(1, 2)) >= shared) & (first == pivot[lo]) & (cos >= least) & (rep[ii] != rep[jj])
                    a.append(rep[ii[ok]])
                    b.append(rep[jj[ok]])
                    na.append(copies[jj[ok]])
                    nb.append(copies[ii[ok]])
            if not a or not (total := sum(map(len, a))):
                continue
            a, b = np.concatenate(a), np.concatenate(b)
            ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            sums = np.bincount(at, weights=np.concatenate([*na, *nb])).astype(np.int64)
            u, v = forest(a, b)
            none = pa.nulls(len(ends), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ends), pa.array(sums), none], names=["a", "n", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.zeros(len(u), dtype=np.int64)), pa.array(v)], names=["a", "n", "b"])
            del total

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, nearest: int = 16, shared: int = 2, block: int = BLOCK
) -> DataFrame:
    """One row (id, n_links, component_id, kept) for each row of vectors.

    A row links to every other row found whose cosine is at least ``least``, rows with equal vectors among them. Null and
    zero vectors, vectors with null or non-finite components and those not of the commonest length link with nothing and
    are components of their own. Rows with equal ids count as vectors each. An empty table gives an empty result. Only
    the two named columns are read.
    """
    spark = vectors.sparkSession
    good = usable(vectors, id_col, vector_col)
    nodes = saved(good.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vectors")
    total = nodes.count()
    every = vectors.select(F.col(id_col).cast("long").alias("id"))
    if total == 0:
        return every.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    n_pivots = int(min(MOST_PIVOTS, max(64, total * nearest // LIST), total))
    sample = np.array([r[0] for r in bounded_sample(nodes.select("vector"), SPARE * n_pivots, "vector")], dtype=np.float64)
    pivots = spread(sample, n_pivots, least)
    n_pivots = len(pivots)
    shared = min(shared, n_pivots)
    described = nodes.mapInArrow(_describe(pivots, nearest), "rep long, copies long, vector array<double>, pivots array<int>")
    lists = described.select("*", F.explode("pivots").alias("pivot"))
    # lists are no more than pivots: their lengths are a few thousand numbers at most
    lengths = {r[0]: r[1] for r in lists.groupBy("pivot").count().collect()}
    blocks = F.create_map(*[F.lit(x) for p, n in lengths.items() if n > block for x in (p, -(-n // block))]) if max(lengths.values()) > block else None
    count = F.coalesce(blocks[F.col("pivot")], F.lit(1)) if blocks is not None else F.lit(1)
    dealt = lists.withColumn("g", count).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))
    # block r meets blocks s >= r as side 0, and blocks s <= r as side 1; with itself it is one side only
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select(
        "rep", "copies", "vector", "pivots", "pivot", F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), F.xxhash64("pivot", low, high).alias("gid")
    )
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    run = _compare(least, shared, n_pivots)
    found = saved(dealt.repartition(n, "gid").sortWithinPartitions("gid", "side").mapInArrow(run, "a long, n long, b long"), "links")
    sums = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("b is not null"), "a", "b")
    told = nodes.join(sums, nodes.rep == sums.a, "left").join(parts, nodes.rep == parts.node, "left")
    told = told.select("vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    linked = good.join(told, "vector").select("id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    v = F.col(vector_col).cast("array<double>")
    length = F.size(F.lit(pivots[0].tolist()))
    bad = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where(
        F.col("vector").isNull() | F.col("id").isNull() | (F.size("vector") != length) | ~F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        | ~F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    )
    lone = bad.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(lone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
