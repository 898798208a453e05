"""Similarity joins of strings: all pairs whose indel ratio reaches a threshold, none lost.

Strings of n and m >= n characters with a ratio of at least r differ by no more than (1 - r)(n + m) lost and added
characters, and that number has the parity of m - n. So p characters of the shorter string are lost and q added at most; a
lost one breaks two of its two-character grams, an added one breaks one, and of any grams that occur more than 2 p + q times
one is in the longer string too. The shorter string offers that many of its rarest grams to each length it can match, and
every string holds all its grams under its own length. Where a string has too few grams for that, single characters serve.

Offers and holders of a gram and length meet in cells of bounded size (``functions/similarity.py``). A pair counts where the
first of the offered grams is that the other string holds; of these pairs, those with enough characters in common are compared
at once. Both are matrix products. Only pairs that reach the threshold leave a cell, or, for groups, a spanning forest of them.

For groups, strings of which one character's loss makes the same string are linked beforehand, by a grouping; only pairs of
different groups meet in cells. Within a key, the members of its largest group meet those of other groups, not each other.

Grams tell numbered names apart badly: thousands share each. Strings have a shape, in which every digit is a 0; two are no
more alike than their shapes are. Strings of a crowded shape meet those of the shapes similar to theirs, and no others, in
cells of blocks by blocks, where all pairs are compared at once (``similarity.Columns``). The other strings meet by grams.
For groups, neighbours in the sorted order are linked beforehand there.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from math import ceil, floor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions.similarity import Columns, bags, lcs_lengths, pieces
from corvina.operators.components import connected_components, forest
from corvina.operators.joins import frequent_limit, join_counted
from corvina.session import saved, tasks_of

#: Offers and holders of a cell.
BLOCK = 2_000
#: Pairs of a batch that leaves a cell.
OUT = 100_000
LEFT, RIGHT = 1, 2
#: Characters of strings that are linked beforehand where one loss makes them equal.
SHORT = 64
#: Strings from which a shape is crowded, where they are a thousandth of all or more.
CROWD = 1_000
#: Strings and characters of a block of a crowded shape; blocks are smaller where there would be too few cells.
MEMBERS, CHARACTERS = 50_000, 4_000_000
#: Pairs that are compared at once in a cell of blocks.
PAIRS = 1_500_000


@cache
def _lost(n: int, m: int, least: float) -> int:
    """How many gram occurrences of a string of n characters one of m >= n can break; negative if the two can't be similar."""
    d = floor((n + m) * (1 - least) + 1e-9)
    d -= (d - (m - n)) % 2
    return -1 if d < m - n else (3 * d - (m - n)) // 2  # 2 p + q, p and q half of d less and plus m - n


@cache
def _weak(n: int, least: float) -> bool:
    """Whether some shorter or equal string can lose all its grams against one of n characters."""
    return any(k - 1 <= _lost(k, n, least) for k in range(min(n, ceil(n * (least / (2 - least)) - 1e-9)), n + 1))


_OFFERS = "x string, l string, side int, c string, m int, g string, earlier string, width int, offer boolean"


def _offers(least: float):
    """Of strings with their grams g (and how often each occurs, k) in the order of rarity: what they offer to each length, with the pieces
    offered before, and what they hold. Where a string can lose all its grams, it offers its characters."""

    def told(n: int, own: str, grams: list[str], often: list[int]) -> Iterator[tuple]:
        chars = list(dict.fromkeys(own))
        before = [0, *accumulate(often)][: len(grams)]
        for m in range(n, max(n, floor(n * ((2 - least) / least) + 1e-9)) + 1):
            lost = _lost(n, m, least)
            if lost >= 0:
                # the first grams that together occur more often than can be lost
                chosen = grams[: bisect_right(before, lost)] if n - 1 > lost else chars
                for k, g in enumerate(chosen):
                    yield m, g, "".join(chosen[:k]), True
        for g in [*grams, *(chars if _weak(n, least) else [])]:
            yield n, g, "", False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at = [], []

            def out(b: pa.RecordBatch, rows: list, at: list) -> pa.RecordBatch:
                m, g, earlier, offer = zip(*rows, strict=True)
                own = [b.column(c).take(pa.array(at)) for c in ("x", "l", "side", "c")]
                return pa.RecordBatch.from_arrays(
                    [*own, pa.array(m, pa.int32()), pa.array(g, pa.string()), pa.array(earlier, pa.string()), pa.array(list(map(len, g)), pa.int32()), pa.array(offer)],
                    names=["x", "l", "side", "c", "m", "g", "earlier", "width", "offer"],
                )

            for i, given in enumerate(zip(*(b.column(c).to_pylist() for c in ("l", "g", "k")), strict=True)):
                for row in told(len(given[0]), given[0], given[1] or [], given[2] or []):
                    rows.append(row)
                    at.append(i)
                    if len(rows) == OUT:
                        yield out(b, rows, at)
                        rows, at = [], []
            if rows:
                yield out(b, rows, at)

    return run


def _compare(least: float, self_join: bool, only_forest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(batches):
            offer = t.column("offer").to_numpy(zero_copy_only=False).astype(bool)
            x, low, sides = t.column("x").to_pylist(), t.column("l").to_pylist(), t.column("side").to_numpy()
            lengths = np.fromiter(map(len, low), dtype=np.int64, count=len(low))
            p, q = np.flatnonzero(offer), np.flatnonzero(~offer)
            if not len(p) or not len(q):
                continue
            order = np.empty(len(x), dtype=np.int64)
            names, order[:] = np.unique(np.array([*x, ""], dtype=object)[:-1], return_inverse=True)
            group = np.unique(np.array([*t.column("c").to_pylist(), ""], dtype=object)[:-1], return_inverse=True)[1] if only_forest else None
            bag = bags(low)
            earlier, held = pieces(t.column("earlier").take(p).to_pylist(), [low[k] for k in q.tolist()], t.column("width")[0].as_py())
            u, v, r = [], [], []
            step = max(1, 1_000_000 // len(q))
            for at in range(0, len(p), step):
                i = p[at : at + step]
                # of equally long strings the smaller one offers
                ok = (lengths[i][:, None] < lengths[q]) | ((lengths[i][:, None] == lengths[q]) & (order[i][:, None] < order[q]))
                if only_forest:
                    ok &= group[i][:, None] != group[q]
                if not self_join:
                    ok &= (sides[i][:, None] | sides[q]) == LEFT | RIGHT
                if not ok.any():
                    continue
                ok &= earlier[at : at + step] @ held.T == 0  # else the pair counts where an earlier gram is
                if bag is not None:
                    ok &= 2 * (bag[i] @ bag[q].T).astype(np.float64) / (lengths[i][:, None] + lengths[q]) >= least
                a, b = np.nonzero(ok)
                a, b = i[a], q[b]
                ratio = 2 * lcs_lengths(low, a, b) / (lengths[a] + lengths[b])
                good = ratio >= least
                u.append(a[good])
                v.append(b[good])
                r.append(ratio[good])
                if only_forest and good.any():
                    one, to = forest(group[a[good]], group[b[good]])
                    now = np.arange(group.max() + 1)
                    now[one] = to
                    group = now[group]
            if not u:
                continue
            a, b, r = np.concatenate(u), np.concatenate(v), np.concatenate(r)
            if not len(a):
                continue
            if only_forest:
                a, b = forest(order[a], order[b])
                yield pa.RecordBatch.from_arrays([pa.array(names[a].tolist(), pa.string()), pa.array(names[b].tolist(), pa.string()), pa.nulls(len(a), pa.float64())], names=["a", "b", "ratio"])
                continue
            yield from _told(pa.array(x, pa.string()), order, sides, a, b, r, self_join)

    return run


def _told(strings: pa.Array, order: np.ndarray, sides: np.ndarray, a: np.ndarray, b: np.ndarray, r: np.ndarray, self_join: bool) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, ratio) of the strings at a and b: the smaller one first, or one of the left side first."""
    if self_join:
        swap = order[a] > order[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
    else:
        one, two = (sides[a] & LEFT > 0) & (sides[b] & RIGHT > 0), (sides[b] & LEFT > 0) & (sides[a] & RIGHT > 0)
        a, b, r = np.concatenate([a[one], b[two]]), np.concatenate([b[one], a[two]]), np.concatenate([r[one], r[two]])
    for at in range(0, len(a), OUT):
        i, j = a[at : at + OUT], b[at : at + OUT]
        yield pa.RecordBatch.from_arrays([strings.take(pa.array(i)), strings.take(pa.array(j)), pa.array(r[at : at + OUT])], names=["a", "b", "ratio"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole cells from batches sorted by cell, and by key if there is one: cells whose hashes are the same then stay apart."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        within = "key" if "key" in b.schema.names else "cell"
        cell, key = b.column("cell").to_numpy(), b.column(within).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (key[1:] != key[:-1])) + 1).tolist(), len(cell)]
        for lo, hi in zip(cut, cut[1:], strict=False):
            if hi == lo:
                continue
            if held and (held[0].column("cell")[0].as_py() != cell[lo] or held[0].column(within)[0].as_py() != key[lo]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _one_lost(e: DataFrame, least: float) -> DataFrame:
    """(a, b) that connect strings (x, l, n) of which the loss of one character makes the same, or which are the same in lower case."""
    less = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.substr(F.col("l"), F.lit(1), i - 1), F.substr(F.col("l"), i + 1, F.col("n"))))
    # two of n characters are alike by (n - 1) / n at least
    near = F.when((F.col("n") <= SHORT) & ((F.col("n") - 1) / F.col("n") >= F.lit(least)), less).otherwise(F.array().cast("array<string>"))
    lost = e.select("x", F.explode(F.array_union(F.array("l"), near)).alias("v"))
    return lost.select(F.lag("x").over(Window.partitionBy("v").orderBy("x")).alias("a"), F.col("x").alias("b")).where("a is not null")


def _between_groups(both: DataFrame) -> DataFrame:
    """Offers and holders with their key split: all offers with holders out of the key's largest group, other offers with the holders in it."""
    sizes = both.groupBy("key", "c").agg(F.count("*").alias("k"))
    most = sizes.groupBy("key").agg(F.sum("k").alias("n"), F.max_by("c", F.struct("k", "c")).alias("most"), F.count("*").alias("groups")).where("groups > 1").drop("groups")
    most = saved(most, "largest")
    total = most.agg(F.sum("n")).first()[0] or 0
    met = join_counted(both, most, "key", "n", frequent_limit(total), "x").where("most is not null")
    inside = F.col("c") == F.col("most")
    parts = F.when(F.col("offer"), F.when(inside, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))).otherwise(F.array(F.when(inside, "b").otherwise("a")))
    return met.withColumn("part", F.explode(parts)).withColumn("key", F.concat("part", F.lit(":"), "key")).drop("part", "most")


def _meet(least: float, self_join: bool, only_forest: bool):
    """Pairs of cells of blocks, whose rows have a role: 0 the first block, 1 the second one, 2 a block that meets itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(batches):
            t = t.sort_by("l")
            low, role, sides, strings = t.column("l").to_pylist(), t.column("role").to_numpy(), t.column("side").to_numpy(), t.column("x").combine_chunks()
            p, q = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
            if not len(p) or not len(q):
                continue
            if only_forest:
                yield from _merged(low, t.column("c").to_pylist(), p, q, least)
                continue
            order = np.empty(len(low), dtype=np.int64)
            order[pc.sort_indices(strings).to_numpy()] = np.arange(len(low))
            for a, b, r in _alike(low, p, q, least):
                if role[p[0]] == 2:
                    once = a < b
                    a, b, r = a[once], b[once], r[once]
                yield from _told(strings, order, sides, a, b, r, self_join)

    return run


def _alike(low: list[str], p: np.ndarray, q: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, ratio) of p by q that reach the threshold, a number of pairs at a time; low is sorted, p and q are places in it."""
    columns = Columns([low[k] for k in q.tolist()], [low[k] for k in p.tolist()], least)
    step = max(8, PAIRS // len(q) // 8 * 8)
    for at in range(0, len(p), step):
        i, j, r = columns.alike(at, min(at + step, len(p)))
        yield p[i], q[j], r


def _merged(low: list[str], groups: list[str], p: np.ndarray, q: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """Links of groups that similar strings of p and q connect; strings of the same group, linked here or before, aren't compared again."""
    known, group = np.unique(np.array([*groups, ""], dtype=object)[:-1], return_inverse=True)
    p = p[np.lexsort([np.random.default_rng(len(p)).permutation(len(p)), group[p]])]  # groups one by one, each in any order
    label, u, v, at, step, most = np.arange(len(known)), [], [], 0, 8, max(8, PAIRS // len(q) // 8 * 8)
    columns, of = None, None
    while at < len(p):
        rows = p[at : at + step]
        own = np.unique(label[group[rows]])
        # if the rows are of one group, only strings of others are compared
        wanted = label[group[q]] != own[0] if len(own) == 1 else np.ones(len(q), dtype=bool)
        apart = np.zeros(0, dtype=bool)
        if wanted.any():
            if columns is None or not np.array_equal(of, wanted):
                columns, of, other = Columns([low[k] for k in q[wanted].tolist()], [low[k] for k in p.tolist()], least), wanted, q[wanted]
            i, j, _ = columns.alike(at, at + len(rows))
            a, b = label[group[p[i]]], label[group[other[j]]]
            apart = a != b
        if apart.any():
            one, to = forest(a[apart], b[apart])
            u.append(one)
            v.append(to)
            now = np.arange(len(known))
            now[one] = to
            label = now[label]
        at += len(rows)
        step = 8 if apart.any() else min(2 * step, most)  # what is merged isn't compared
    if u:
        a, b = np.concatenate(u), np.concatenate(v)
        yield pa.RecordBatch.from_arrays([pa.array(known[a].tolist(), pa.string()), pa.array(known[b].tolist(), pa.string()), pa.nulls(len(a), pa.float64())], names=["a", "b", "ratio"])


def _runs(least: float):
    """Strings (x, l), sorted by l in each task, with the first string c of the run they are in, as long as neighbours are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, root = None, None
        for b in batches:
            if not b.num_rows:
                continue
            x, low = b.column("x").to_pylist(), b.column("l").to_pylist()
            low = [low[0] if last is None else last, *low]
            k = np.arange(b.num_rows)
            lengths = np.fromiter(map(len, low), dtype=np.int64, count=len(low))
            near = 2 * lcs_lengths(low, k, k + 1) / (lengths[k] + lengths[k + 1]) >= least
            roots = []
            for name, goes_on in zip(x, near.tolist(), strict=True):
                if root is None or not goes_on:
                    root = name
                roots.append(root)
            last = low[-1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("x", "side", "l", "n", "shape")), pa.array(roots, pa.string())], names=["x", "side", "l", "n", "shape", "c"])

    return run


def _in_blocks(e: DataFrame, shapes: DataFrame, near: DataFrame, least: float, self_join: bool, only_forest: bool, limit: int) -> DataFrame:
    """Pairs of strings (x, l, side, c, shape) of crowded shapes and of those near them. shapes: (shape, n, crowded); near: (shape, other)."""
    tasks = tasks_of(e.sparkSession)
    sizes = shapes.select("shape", F.col("n").cast("double").alias("n"))
    others = near.join(sizes.withColumnRenamed("shape", "other"), "other").groupBy("shape").agg(F.sum("n").alias("m"))
    work = saved(shapes.where("crowded").select("shape", F.col("n").cast("double").alias("n")).join(others, "shape", "left").withColumn("id", 2 * F.monotonically_increasing_id()), "crowded")
    pairs = work.agg(F.sum(F.col("n") * (F.col("n") / 2 + F.coalesce("m", F.lit(0.0))))).first()[0]
    # eight cells a task, if blocks of BLOCK strings at least make as many
    block = F.greatest(F.lit(1), F.least(F.lit(int(min(MEMBERS, max(BLOCK, (pairs / (8 * tasks)) ** 0.5)))), F.floor(CHARACTERS / F.length("shape"))))
    work = saved(work.withColumn("own", F.ceil(F.col("n") / block)).withColumn("over", F.ceil(F.col("m") / block)), "blocks")
    cells = work.agg(F.sum(F.col("own") * (F.col("own") + 1) / 2 + F.col("own") * F.coalesce("over", F.lit(0)))).first()[0]

    def part(cell, role, own, across):
        return F.struct(cell.cast("long").alias("key"), F.lit(role).alias("role"), F.col(own).alias("own"), F.col(across).alias("across"))

    parts = work.select("shape", part(F.col("id"), 2, "own", "own").alias("part"))
    parts = parts.unionByName(work.where("over is not null").select("shape", part(F.col("id") + 1, 0, "own", "over").alias("part")))
    parts = parts.unionByName(near.join(work, "shape").select(F.col("other").alias("shape"), part(F.col("id") + 1, 1, "over", "own").alias("part")))
    parts = saved(parts.groupBy("shape").agg(F.collect_list("part").alias("parts")).join(shapes.select("shape", "n"), "shape"), "parts")  # no more than there are crowded shapes
    dealt = join_counted(e, parts, "shape", "n", limit, "x").where("parts is not null").select("x", "l", "side", "c", F.explode("parts").alias("part"))
    dealt = dealt.select("x", "l", "side", "c", "part.*").withColumn("at", F.pmod(F.xxhash64("x"), F.col("own"))).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("across") - 1)))
    role = F.when(F.col("role") < 2, F.col("role")).when(F.col("at") == F.col("to"), 2).otherwise((F.col("at") > F.col("to")).cast("int"))
    first, second = (F.when(F.col("role") == 2, f("at", "to")).when(F.col("role") == k, F.col("at")).otherwise(F.col("to")) for k, f in ((0, F.least), (1, F.greatest)))
    dealt = dealt.select("x", "l", "side", "c", role.alias("role"), "key", (first * (1 << 31) + second).alias("cell"))
    # four times the cells, so that few tasks have several
    dealt = dealt.repartition(max(tasks, min(4 * int(cells), 4_000)), "key", "cell").sortWithinPartitions("key", "cell")
    return dealt.mapInArrow(_meet(least, self_join, only_forest), "a string, b string, ratio double")


def _join(strings: DataFrame, least: float, self_join: bool, only_forest: bool) -> DataFrame:
    spark = strings.sparkSession
    e = strings.where("x is not null and x <> ''").groupBy("x").agg(F.bit_or("side").alias("side"))
    e = e.withColumn("l", F.lower("x")).withColumn("n", F.length("l")).withColumn("shape", F.translate("l", "123456789", "0" * 9))
    e = saved(e, "strings")
    total = e.count()
    if total < CROWD:
        return _by_grams(e, least, self_join, only_forest)
    shapes = e.groupBy("shape").agg(F.count("*").alias("n"), F.bit_or("side").alias("side"))
    limit = max(CROWD, total // 1_000) - 1
    shapes = saved(shapes.withColumn("crowded", F.col("n") > limit), "shapes")
    if not shapes.where("crowded").count():
        return _by_grams(e, least, self_join, only_forest)

    crowded = F.broadcast(shapes.where("crowded").select("shape"))  # a thousand at most
    plain, many = e.join(crowded, "shape", "left_anti"), e.join(crowded, "shape", "left_semi")
    asked = shapes.select(F.col("shape").alias("x"), F.when(F.col("crowded"), LEFT | RIGHT).otherwise(RIGHT).alias("side"))
    near = _by_grams(asked.withColumn("l", F.col("x")).withColumn("n", F.length("l")), least, False, False).select(F.col("a").alias("shape"), F.col("b").alias("other"))
    # of two crowded shapes the smaller one is asked for
    near = near.join(F.broadcast(shapes.where("crowded").select(F.col("shape").alias("other"), F.lit(True).alias("both"))), "other", "left")
    near = saved(near.where("both is null or shape < other").select("shape", "other"), "near")

    links = None
    if only_forest:
        many = many.repartitionByRange(tasks_of(spark), "shape", "l", "x").sortWithinPartitions("shape", "l", "x")
        many = saved(many.select("x", "side", "l", "n", "shape").mapInArrow(_runs(least), "x string, side int, l string, n int, shape string, c string"), "runs")
        links = many.where("x <> c").select(F.col("c").alias("a"), F.col("x").alias("b"), F.lit(None).cast("double").alias("ratio"))
        met = many.unionByName(plain.withColumn("c", F.col("x")))
    else:
        met = e.withColumn("c", F.lit(None).cast("string"))
    found = _in_blocks(met, shapes, near, least, self_join, only_forest, limit)
    found = found.unionByName(_by_grams(plain.select("x", "side", "l", "n"), least, self_join, only_forest))
    return found.unionByName(links).distinct() if only_forest else found


def _by_grams(e: DataFrame, least: float, self_join: bool, only_forest: bool) -> DataFrame:
    """Pairs of distinct strings (x, side, l, n)."""
    spark = e.sparkSession
    e = e.select("x", "side", "l", "n")
    linked = None
    if only_forest:
        e = saved(e, "names")
        groups = saved(connected_components(_one_lost(e, least), "a", "b"), "groups")
        e = e.join(groups.withColumnRenamed("node", "x"), "x", "left").withColumn("c", F.coalesce("component", "x")).drop("component")
        linked = groups.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"), F.lit(None).cast("double").alias("ratio"))
    else:
        e = e.withColumn("c", F.lit(None).cast("string"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1))), lambda i: F.substr(F.col("l"), i, F.lit(2)))
    grams = e.select("x", F.explode(F.when(F.col("n") > 1, pairs).otherwise(F.array().cast("array<string>"))).alias("g")).groupBy("x", "g").agg(F.count("*").alias("c"))
    grams = saved(grams, "grams")
    seen = grams.groupBy("g").agg(F.count("*").alias("df")).withColumn("n", F.col("df"))
    ranked = join_counted(grams, seen, "g", "n", frequent_limit(grams.count()), "x")
    own = ranked.groupBy("x").agg(F.array_sort(F.collect_list(F.struct("df", "g", "c"))).alias("r"))  # no more than a string has
    told = e.join(own, "x", "left").select("x", "l", "side", "c", F.col("r.g").alias("g"), F.col("r.c").alias("k"))
    tasks = tasks_of(spark)
    both = saved(told.repartition(tasks, "x").mapInArrow(_offers(least), _OFFERS).withColumn("key", F.concat(F.col("m").cast("string"), F.lit(":"), "g")), "offers")
    if only_forest:
        both = saved(_between_groups(both), "between")

    counts = both.groupBy("key").agg(F.count_if("offer").alias("o"), F.count_if(~F.col("offer")).alias("h")).where("o > 0 and h > 0")
    counts = saved(counts.withColumn("n", F.col("o") + F.col("h")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    met = join_counted(both, counts, "key", "n", frequent_limit(total), "x").where("o is not null")
    across = F.when(F.col("offer"), F.col("h")).otherwise(F.col("o"))
    blocks, own_blocks = F.ceil(across / BLOCK), F.ceil(F.when(F.col("offer"), F.col("o")).otherwise(F.col("h")) / BLOCK)
    block = F.pmod(F.xxhash64("x"), own_blocks)
    dealt = met.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    place = F.when(F.col("offer"), F.struct("own", "other")).otherwise(F.struct(F.col("other").alias("own"), F.col("own").alias("other")))
    dealt = dealt.select("x", "l", "side", "c", "earlier", "offer", "width", "key", F.xxhash64("key", place).alias("cell"))
    parts = max(tasks, total // 200_000)
    dealt = dealt.repartition(parts, "cell").sortWithinPartitions("cell", "key")
    found = dealt.mapInArrow(_compare(least, self_join, only_forest), "a string, b string, ratio double")
    return found.unionByName(linked).distinct() if only_forest else found


def similar_strings(entities: DataFrame, least: float = 0.85, name: str = "entity") -> DataFrame:
    """(a, b, ratio) with a < b and a ratio of at least ``least``, which is over 0.5: no pair is lost.

    Ratios are of lower-cased strings. Null and empty strings match nothing, repeated ones count once.
    """
    return _join(entities.select(F.col(name).alias("x"), F.lit(LEFT | RIGHT).alias("side")), least, True, False)


def similar_links(entities: DataFrame, least: float = 0.85, name: str = "entity") -> DataFrame:
    """(a, b) that connect exactly those strings which chains of similar pairs connect: far fewer than pairs in dense groups."""
    return _join(entities.select(F.col(name).alias("x"), F.lit(LEFT | RIGHT).alias("side")), least, True, True).select("a", "b")


def similar_between(left: DataFrame, right: DataFrame, least: float, name: str = "name") -> DataFrame:
    """(a, b, ratio): a of left, b of right, equal strings among them, with a ratio of at least ``least``."""
    sides = left.select(F.col(name).alias("x"), F.lit(LEFT).alias("side")).unionByName(right.select(F.col(name).alias("x"), F.lit(RIGHT).alias("side")))
    strings = sides.groupBy("x").agg(F.bit_or("side").alias("side"))
    equal = strings.where((F.col("side") == LEFT | RIGHT) & F.col("x").isNotNull()).select(F.col("x").alias("a"), F.col("x").alias("b"), F.lit(1.0).alias("ratio"))
    return _join(strings, least, False, False).where("a <> b").unionByName(equal)
