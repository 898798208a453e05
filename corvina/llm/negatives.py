"""Hard negatives for anchors by full exact scores, computed by the method of the Four Russians.

Vectors become integers, and a candidate is stored as bit planes: bit b of its components, eight dimensions to a byte. For
each group of eight dimensions an anchor has a table of the 256 sums of subsets of its components. A score is then a sum of
lookups: for each plane, from the sign down, the sum so far is doubled and the entries that the candidate's bytes name are
added (the sign plane counts negatively). No product is computed, and scores are exact.

Anchors are a stated query set. They meet all candidates in cells of an anchor block and a candidate block, so the work is
spread over cells of bounded size. Two passes go over the cells: the first finds each anchor's best rows of its own label
(only rows of the anchors' labels are scored), the second its best rows of other labels in the window that each positive
sets. A cell returns what can still be among the first so many, and windows over these few rows finish.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.llm.common import group_slices, whole_groups
from corvina.session import saved

#: Rows of an anchor block (its tables take 2 KB for each group of eight dimensions, or 1 KB for small scores), of a candidate block, and at a time.
ANCHORS, CANDIDATES, AT_ONCE = 512, 65_536, 2_048
ROW = "uid long, id long, label long"


def integers(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: float) -> DataFrame:
    """(id, label, q) of the rows that take part, q the components times scale, rounded down (a double that holds an integer)."""
    v = F.col(vector_col).cast("array<double>")
    good = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v")).where("id is not null and label is not null and v is not null")
    good = good.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # a component so large that its multiple is infinite is bounded later
    return good.select("id", "label", F.transform("v", lambda x: F.least(F.greatest(x * scale, F.lit(-1e15)), F.lit(1e15))).alias("q")).withColumn("q", F.transform("q", lambda x: F.floor(x)))


def bound(dims: int) -> int:
    """Components are bounded so that a hundred times any score is a long."""
    return math.isqrt((2**63 - 1) // (100 * max(1, dims))) - 1


def _padded(column: pa.Array, dims: int, most: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), dims), dtype=np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return np.clip(out, -most, most)


def pack(q: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes, groups) bytes: the bits of q in two's complement from the sign plane down, eight dimensions to a byte."""
    shifts = np.arange(planes - 1, -1, -1)
    bits = ((q[:, None, :] >> shifts[None, :, None]) & 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little")


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, anchors): entry s of a group sums the components whose bits s has."""
    groups = anchors.reshape(len(anchors), -1, 8)
    out = np.zeros((groups.shape[1], 256, len(anchors)), dtype=kind)
    for bit in range(8):
        # each table doubles: the sums with this bit are those without it, plus its component
        out[:, 1 << bit : 2 << bit] = out[:, : 1 << bit] + groups[:, :, bit].T[:, None, :].astype(kind)
    return out


def scores(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """(candidates, anchors): lookups, shifted and added."""
    total = np.zeros((len(packed), tables.shape[2]), dtype=tables.dtype)
    entry = np.empty_like(total)
    for plane in range(packed.shape[1]):
        if plane:
            np.left_shift(total, 1, out=total)
        for group, table in enumerate(tables):
            np.take(table, packed[:, plane, group], axis=0, out=entry)
            if plane:
                np.add(total, entry, out=total)
            else:
                np.subtract(total, entry, out=total)
    return total


def _packer(dims: int, planes: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = pack(_padded(b.column("q"), dims, most), planes).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("uid", "id", "label", "is_anchor")), b.column("q"), pa.array([r.tobytes() for r in packed], pa.binary())], names=["uid", "id", "label", "is_anchor", "q", "bits"])

    return run


def _first(order_by: list[np.ndarray], group: np.ndarray, k: int) -> np.ndarray:
    """Rows that are among the first k of their group, in the order of the keys (the most important first)."""
    order = np.lexsort([*order_by[::-1], group])
    g = group[order]
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, dtype=np.int64)
    place = np.arange(len(g)) - np.repeat(start, np.diff(np.concatenate([start, [len(g)]])))
    return order[place < k]


def _cells(dims: int, planes: int, most: int, k: int, negatives: bool, low: int, high: int):
    """For each cell the rows (anchor, [positive, positive_score,] candidate, score) that can be among the first k."""
    kind = np.int32 if 2 * dims * most * (most + 1) < 2**31 else np.int64  # partial sums stay within this too
    groups = dims // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _one_by_one(batches):
            side = t.column("side").to_numpy()
            cut = int(np.searchsorted(side, 1))  # anchors come before candidates
            if not 0 < cut < len(side):
                continue
            uid, ids, label = (t.column(c).to_numpy() for c in ("uid", "id", "label"))
            tables = subset_sums(_padded(t.column("q").slice(0, cut), dims, most), kind)
            bits = np.frombuffer(b"".join(t.column("bits").slice(cut).to_pylist()), dtype=np.uint8).reshape(-1, planes, groups)
            wanted = t.column("positives").slice(0, cut).to_pylist() if negatives else None
            found: list[tuple] = []
            if negatives:
                pieces = ((np.arange(cut), np.arange(at, min(at + AT_ONCE, len(bits)))) for at in range(0, len(bits), AT_ONCE))
            else:
                pieces = _same_label(label[:cut], label[cut:])
            for rows, columns in pieces:
                block = scores(tables if len(rows) == cut else np.ascontiguousarray(tables[:, :, rows]), bits[columns]).T.astype(np.int64)
                at = columns + cut
                for a, s in zip(rows.tolist(), block, strict=True):
                    if negatives:
                        found += _in_windows(a, s, at, ids, label, wanted[a], k, low, high)
                    else:
                        other = np.flatnonzero(uid[at] != uid[a])
                        best = other[np.lexsort((ids[at[other]], -s[other]))[:k]]
                        found.append((np.full(len(best), a), at[best], s[best]))
            if not found:
                continue
            columns = [np.concatenate(c) for c in zip(*found, strict=True)]
            a, c, s = columns[0], columns[-2], columns[-1]
            group = a if not negatives else a * (1 + max(len(w or ()) for w in wanted)) + columns[1]
            keep = _first([-s, ids[c]], group, k)
            a, c, s = a[keep], c[keep], s[keep]
            out = [uid[a], ids[a], uid[c], ids[c], s]
            names = ["anchor_uid", "anchor_id", "uid", "id", "score"]
            if negatives:
                p = [wanted[x][y] for x, y in zip(a.tolist(), columns[1][keep].tolist(), strict=True)]
                out += [np.array([x[n] for x in p], dtype=np.int64) for n in ("uid", "id", "score")]
                names += ["positive_uid", "positive_id", "positive_score"]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)

    return run


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for t in whole_groups(batches, "cell"):
        for lo, hi in group_slices(t.column("cell").to_numpy()):
            yield t.slice(lo, hi - lo)


def _same_label(anchors: np.ndarray, candidates: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for one in np.unique(anchors):
        rows, own = np.flatnonzero(anchors == one), np.flatnonzero(candidates == one)
        for at in range(0, len(own), AT_ONCE):
            yield rows, own[at : at + AT_ONCE]


def _in_windows(a: int, s: np.ndarray, at: np.ndarray, ids: np.ndarray, label: np.ndarray, positives: list, k: int, low: int, high: int) -> list[tuple]:
    """For each positive of anchor a the first k candidates of other labels in its window; one sort serves all positives."""
    edges = [(-((-low * p["score"]) // 100), (high * p["score"]) // 100) for p in positives or ()]
    edges = [(lo, hi, n) for n, (lo, hi) in enumerate(edges) if lo <= hi]
    if not edges:
        return []
    can = np.flatnonzero((label[at] != label[a]) & (s >= min(e[0] for e in edges)) & (s <= max(e[1] for e in edges)))
    can = can[np.lexsort((ids[at[can]], -s[can]))]
    fallen, out = -s[can], []
    for lo, hi, n in edges:
        first, last = np.searchsorted(fallen, -hi, "left"), np.searchsorted(fallen, -lo, "right")
        best = can[first : min(last, first + k)]
        out.append((np.full(len(best), a), np.full(len(best), n), at[best], s[best]))
    return out


def mine(
    vectors: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, id_col: str = "vec_id",
    vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives for each anchor and positive.

    ``is_anchor`` is a SQL condition on column id. Components times ``scale`` are rounded down; a score is the inner product
    of two rows' integers. An anchor's positives are its first rows of the same label (the row itself isn't one), its
    negatives for a positive the first rows of other labels with low * positive_score <= 100 * score <= high *
    positive_score: highest score first, ties by smaller id. All are taken where there are fewer.

    Rows with a null id, label, vector or component and rows with a non-finite component take no part; zero vectors do.
    Shorter vectors count as filled up with zeros. Rows with equal ids are rows each, as anchors too. Components are bounded
    (for 64 dimensions at about 148,000 after division by 256), so that no score overflows. No anchors, or no rows, give an
    empty result. Only the three named columns are read.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, id_col, vector_col, label_col, scale).withColumn("uid", F.monotonically_increasing_id())
    rows = saved(rows.withColumn("is_anchor", F.coalesce(F.expr(is_anchor), F.lit(False))), "integers")  # from here on uid is fixed
    total, anchors, dims, largest = rows.agg(F.count("*"), F.count_if("is_anchor"), F.max(F.size("q")), F.max(F.array_max(F.transform("q", lambda x: F.abs(x))))).first()
    dims = max(8, -(-(dims or 0) // 8) * 8)
    most = min(bound(dims), int(largest or 0))
    planes = most.bit_length() + 1
    packed = saved(rows.mapInArrow(_packer(dims, planes, most), f"{ROW}, is_anchor boolean, q array<long>, bits binary"), "planes")

    across = -(-(anchors or 0) // ANCHORS)
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    down = max(1, min(max(-(-least // max(1, across)), -(-total // CANDIDATES)), total))
    side_a = packed.where("is_anchor").select("uid", "id", "label", "q", F.lit(None).cast("binary").alias("bits"), F.pmod(F.xxhash64("uid"), F.lit(max(1, across))).alias("block"))
    side_b = packed.select("uid", "id", "label", F.lit(None).cast("array<long>").alias("q"), "bits", F.pmod(F.xxhash64("uid"), F.lit(down)).alias("block"))

    def cells(a: DataFrame, k: int, with_negatives: bool, schema: str) -> DataFrame:
        left = a.select("*", F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("other")).withColumn("cell", F.col("block") * down + F.col("other"))
        right = side_b.select("*", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(max(1, across) - 1))).alias("other")).withColumn("cell", F.col("other") * down + F.col("block"))
        both = left.drop("block", "other").unionByName(right.drop("block", "other"), allowMissingColumns=True)
        dealt = both.repartition(max(1, across) * down, "cell").sortWithinPartitions("cell", "side", "id", "uid")
        return dealt.mapInArrow(_cells(dims, planes, most, k, with_negatives, low, high), schema)

    pair = "anchor_uid long, anchor_id long, uid long, id long, score long"
    best = Window.partitionBy("anchor_uid").orderBy(F.desc("score"), "id", "uid")
    chosen = cells(side_a, positives, False, pair).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives)
    given = chosen.groupBy(F.col("anchor_uid").alias("uid")).agg(F.sort_array(F.collect_list(F.struct("rank", "uid", "id", "score"))).alias("positives"))
    with_positives = saved(side_a.join(given, "uid"), "anchors")

    found = cells(with_positives, negatives, True, f"{pair}, positive_uid long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_uid", "positive_uid").orderBy(F.desc("score"), "id", "uid")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
