"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.operators.joins import frequent_limit, join_counted
from corvina.session import saved


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) over the pairs a-b, without the stars' centres."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low != high
        if not open_.any():
            break
        x, y, low, high = x[open_], y[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while (up := root[root]).tolist() != root.tolist():
            root = up
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars; of each hundred thousand and what is left of those before."""
    kind, u, v, n = None, [], [], 0

    def stars() -> tuple[np.ndarray, np.ndarray]:
        return forest(np.concatenate(u), np.concatenate(v))

    for b in batches:
        kind = b.schema.field("u").type
        u.append(b.column("u").to_numpy(zero_copy_only=False))
        v.append(b.column("v").to_numpy(zero_copy_only=False))
        n += b.num_rows
        if n > 100_000:
            a, c = stars()
            u, v, n = [a], [c], 0
    if u:
        a, c = stars()
        yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(c, kind)], names=["u", "v"])


def _large_star(edges: DataFrame, limit: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_counted(both.where("v > u"), least, "u", "n", limit, "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, limit: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_counted(edges, least, "u", "n", limit, "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def _peeled(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges (u, v) without those whose larger end u has no other, and those edges: what such an end is in, its v is in."""
    both = edges.select("u").unionByName(edges.select(F.col("v").alias("u")))
    ones = both.groupBy("u").agg(F.count("*").alias("n")).where("n = 1").select("u", F.lit(True).alias("leaf"))
    marked = saved(edges.join(ones, "u", "left").select("u", "v", F.coalesce("leaf", F.lit(False)).alias("leaf")), "marked")
    return marked.where("not leaf").drop("leaf"), marked.where("leaf").drop("leaf")


def _with_leaves(found: DataFrame, leaves: DataFrame) -> DataFrame:
    """Rows (node, component) of found and of the ends that were taken off."""
    counts = leaves.groupBy("v").agg(F.count("*").alias("n"))
    ends = saved(counts.join(found.withColumnRenamed("node", "v"), "v", "left"), "ends")
    limit = frequent_limit(leaves.count())
    held = join_counted(leaves, ends.select("v", "n", F.coalesce("component", "v").alias("component")), "v", "n", limit, "u")
    alone = ends.where("component is null").select(F.col("v").alias("node"), F.col("v").alias("component"))
    return found.unionByName(alone).unionByName(held.select(F.col("u").alias("node"), "component"))


#: Times that ends with one edge are taken off, as long as a quarter of the edges goes each time.
PEELS = 3
#: Edges that one task joins up by itself; rounds are for more.
ONE_TASK = 500_000


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component): the smallest node that each node of an edge reaches by edges.

    Edges with a null end and self loops count for nothing. Every round writes the remaining star edges to the shared
    folder, so that the plan stays short, and begins by contracting the edges of each scan partition on their own; the number
    of rounds grows with the logarithm of the longest chain. Once no more than ONE_TASK edges are left, one task ends the
    work. Before the rounds, ends with a single edge are taken off, if they aren't the smallest of their component, and get the
    component of their neighbour afterwards. No node's neighbours are ever gathered in one place: minima have partial results, and a node with many edges, of
    which there are few, meets them by a broadcast.
    """
    now = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    now = saved(now, "edges")
    before, off = _state(now), []
    while before[0] > ONE_TASK and len(off) < PEELS:
        now, leaves = _peeled(now)
        off.append(leaves)
        whole, before = before[0], _state(now)
        if before[0] > 0.75 * whole:
            break
    for _ in range(max_rounds):
        if before[0] <= ONE_TASK:
            now = saved(now.coalesce(1).mapInArrow(_contract, now.schema), "edges") if before[0] else now
            break
        stars = now.mapInArrow(_contract, now.schema)  # a scan's partitions are of bounded size
        limit = frequent_limit(2 * before[0])
        now = saved(_small_star(_large_star(stars, limit), limit), "edges")
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
    for leaves in reversed(off):
        found = _with_leaves(found, leaves)
    return found
