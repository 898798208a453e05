"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are made in Arrow batches: XXH64 of every word shingle, and a bit is set where more than half of the hashes
have it. Texts with equal fingerprints are merged first, so that copies cost one row. The 64 bit positions are grouped
into partitions of correlated bits; partition i has a threshold t_i, and the thresholds sum to the distance less the
number of partitions plus one, so that every linked pair differs by at most t_i bits in some partition. How many
partitions, and which threshold each gets, is decided by dynamic programming over estimated costs (probe rows plus
candidate pairs, from the collisions of a bounded sample scaled to the number of fingerprints). Any outcome is exact; the
sample only moves cost. A fingerprint is indexed under its value in each partition and probes all values within t_i.

For a stated similarity of shingle sets fingerprints only find candidates, and loosely, so that hardly a pair is lost:
several fingerprints, made from the same hashes, are probed, and all of them together part what is far apart. Few bits need
to agree in one of many partitions for that, so probes are few. The exact similarity of shingle sets decides: a first round
takes a spanning forest of closer candidates, so that dense groups become one; then the components of all candidates are cut
into blocks, and each two blocks that may hold a link between different groups meet with their sets in one bounded group,
where pairs are compared and a forest of the links is all that leaves.

A value that gathers many fingerprints is cut into blocks, and every pair of blocks is a group of bounded size of its
own. A group's task compares its fingerprints and returns a spanning forest of the links found, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import bounded_sample, group_slices, whole_groups
from corvina.llm.vectors import matrix
from corvina.operators.components import connected_components, forest
from corvina.operators.joins import frequent_limit, join_counted
from corvina.session import saved

#: Rows of the sample that costs are estimated on.
SAMPLE = 20_000
#: Fingerprints in a block of a large group.
BLOCK = 1_000
#: Cost of moving a probe row, in compared pairs.
PROBE_COST = 400.0
_CHUNK = 1 << 15


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, in arrays of bounded size; none for null or no word."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not tokens:
        return
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    first = (ends - lengths)[:n].tolist()
    last = (ends[words - 1 :] if len(tokens) >= words else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        yield np.array([digest(joined[s:e], 42) for s, e in zip(first[at : at + _CHUNK], last[at : at + _CHUNK], strict=True)], dtype="<u8")


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The hashes of a text's shingles, each once, in ascending order."""
    return np.unique(np.concatenate([np.zeros(0, dtype="<u8"), *shingle_hashes(text, words)]))


def fingerprint(hashes: Iterable[np.ndarray], extra: int = 0) -> list[int]:
    """The 64-bit fingerprint as a signed long, and ``extra`` more from other hashes; all 0 without any hash."""
    counts, n = np.zeros((1 + extra, 64), dtype=np.int64), 0
    for h in hashes:
        n += len(h)
        for k in range(1 + extra):
            if k:
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
                h = h ^ (h >> np.uint64(32))
            counts[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").view("<i8").ravel().tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [fingerprint(shingle_hashes(x.as_py(), words))[0] for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, fp long")


def set_fingerprints(rows: DataFrame, words: int, extra: int) -> DataFrame:
    """(id, key, mark, fp, more) of every row (id, key, t): mark is a hash of the set of shingles, which the fingerprints are of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks, fps, more = [], [], []
            for x in b.column("t"):
                h = shingle_set(x.as_py(), words)
                fp, *others = fingerprint(np.split(h, range(_CHUNK, len(h), _CHUNK)), extra)
                marks.append(int(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).view(np.int64)))
                fps.append(fp)
                more.append(others)
            columns = [b.column("id"), b.column("key"), pa.array(marks, pa.int64()), pa.array(fps, pa.int64()), pa.array(more, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "mark", "fp", "more"])

    return rows.select("id", "key", "t").mapInArrow(run, "id long, key long, mark long, fp long, more array<long>")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps, dtype="<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal size; each grows by the bit most correlated with those it has."""
    x = bits.astype(np.float64) - bits.mean(axis=0)
    s = np.sqrt((x * x).sum(axis=0))
    s[s == 0] = 1
    corr = np.abs(x.T @ x) / np.outer(s, s)
    free, parts = set(range(64)), []
    for i in range(m):
        width = (64 - (64 // m) * m > i) + 64 // m
        part = [min(free)]
        free.discard(part[0])
        while len(part) < width:
            best = max(free, key=lambda b: (corr[b, part].sum(), -b))
            part.append(best)
            free.discard(best)
        parts.append(sorted(part))
    return parts


def _pair_counts(bits: np.ndarray, part: list[int], most: int, scale: float) -> list[float]:
    """Estimated pairs within 0..most differing bits of a partition: collisions in the sample, scaled, plus chance ones."""
    values = bits[:, part].astype(np.int64) @ (1 << np.arange(len(part), dtype=np.int64))
    v, c = np.unique(values, return_counts=True)
    found, out = float((c * (c - 1) / 2).sum()), []
    for t in range(most + 1):
        for flips in combinations(range(len(part)), t) if t else ():
            w = v ^ sum(1 << b for b in flips)
            at = np.minimum(np.searchsorted(v, w), len(v) - 1)
            found += float((c * c[at] * (v[at] == w)).sum() / 2)
        out.append(found * scale)
    return out


def plan(sample: np.ndarray, total: int, distance: int, fewest: int = 2) -> list[tuple[list[int], int]]:
    """At least ``fewest`` partitions (bit positions) with their thresholds, -1 for those left out, at the least estimated cost."""
    bits = _bits(sample)
    scale = (total / max(1, len(sample))) ** 2
    best: tuple[float, list] = (np.inf, [])
    for m in range(fewest, min(distance + 2, 10)):
        budget = distance - m + 1
        most = min(budget, 2)
        if m * most < budget:  # no thresholds of at most two sum to it
            continue
        parts = _group_bits(bits, m)
        costs = []
        for part in parts:
            pairs = _pair_counts(bits, part, most, scale)
            probes = np.cumsum([1, len(part), len(part) * (len(part) - 1) / 2])
            costs.append({-1: 0.0} | {t: pairs[t] + PROBE_COST * total * (1 + probes[t]) for t in range(most + 1)})
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            grown: dict[int, tuple[float, list[int]]] = {}
            for used, (c, chosen) in state.items():
                for t, more in cost.items():
                    if (k := used + t) not in grown or c + more < grown[k][0]:
                        grown[k] = (c + more, [*chosen, t])
            state = grown
        if budget in state and state[budget][0] < best[0]:
            best = (state[budget][0], list(zip(parts, state[budget][1], strict=True)))
    return best[1]


def _project(fp, bits: list[int]):
    """The partition's value: its bits, packed in runs of neighbours."""
    out, i, to = F.lit(0).cast("long"), 0, 0
    while i < len(bits):
        j = i
        while j + 1 < len(bits) and bits[j + 1] == bits[j] + 1:
            j += 1
        run = F.shiftrightunsigned(fp, bits[i]).bitwiseAND(F.lit((1 << (j - i + 1)) - 1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(run, to))
        to, i = to + j - i + 1, j + 1
    return out


def _entries(bits: list[int], most: int, part: int):
    """What a fingerprint is indexed under and probes in one partition."""
    masks = [sum(1 << b for b in c) for t in range(most + 1) for c in combinations(range(len(bits)), t)]
    value, flips = _project(F.col("fp"), bits), F.array(*[F.lit(m).cast("long") for m in masks])
    return F.transform(flips, lambda m: F.struct(F.lit(part).alias("part"), value.bitwiseXOR(m).alias("value"), F.when(m == 0, 0).otherwise(1).alias("probe")))


def _spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) pairs that connect what the true entries of a matrix connect; few even where most entries are true.

    While there are many entries, the fullest row's columns are one component: every other row that has one of them needs
    a single pair. ``near`` is used up.
    """
    rows, columns = [], []
    while (total := int(near.sum())) > 4 * sum(near.shape):
        r = int(near.sum(axis=1).argmax())
        own = np.flatnonzero(near[r])
        others = np.flatnonzero(near[:, own].any(axis=1))
        rows += [np.full(len(own), r), others]
        columns += [own, np.full(len(others), own[0])]
        near[:, own] = False
    if total:
        i, j = np.nonzero(near)
        rows.append(i)
        columns.append(j)
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.zeros(0, int), np.zeros(0, int))


def _verify(distance: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "gid"):
            gid, probe, fp, node = (t.column(c).to_numpy() for c in ("gid", "probe", "fp", "node"))
            fp = fp.view(np.uint64)  # bits of signed numbers would be counted without their sign
            more = matrix(t.column("more")).view(np.uint64) if limit else None
            a, b, pairs = [], [], 0

            def flush():
                x, y = forest(np.concatenate(a), np.concatenate(b))
                return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

            for lo, hi in group_slices(gid):
                cut = lo + int(np.searchsorted(probe[lo:hi], 1))
                index = slice(lo, cut)
                if lo == cut or hi - lo < 2:
                    continue
                step = max(1, 4_000_000 // (cut - lo))
                for at in range(lo, hi, step):  # rows that index also ask
                    asks = slice(at, min(hi, at + step))
                    near = np.bitwise_count(fp[asks, None] ^ fp[None, index]) <= distance
                    if limit and near.mean() > 0.02:
                        far = np.bitwise_count(fp[asks, None] ^ fp[None, index]).astype(np.int16)
                        for k in range(more.shape[1]):
                            far += np.bitwise_count(more[asks, None, k] ^ more[None, index, k])
                        near &= far <= limit
                    elif limit:
                        i, j = np.nonzero(near)
                        far = np.bitwise_count(fp[i + at] ^ fp[j + lo]).astype(np.int16)
                        for k in range(more.shape[1]):
                            far += np.bitwise_count(more[i + at, k] ^ more[j + lo, k])
                        drop = far > limit
                        near[i[drop], j[drop]] = False
                    i, j = _spanning(near)
                    i, j = i + at, j + lo
                    keep = node[i] != node[j]
                    if not keep.any():
                        continue
                    a.append(node[i[keep]])
                    b.append(node[j[keep]])
                    pairs += int(keep.sum())
                    if pairs > 1_000_000:
                        out = flush()
                        a, b, pairs = [out.column(0).to_numpy()], [out.column(1).to_numpy()], out.num_rows
            if pairs:
                yield flush()

    return run


def links(nodes: DataFrame, distance: int = 4, limit: int = 0, sample: int = SAMPLE, block: int = BLOCK, turns: int = 1, probed: int | None = None, fewest: int = 2) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of rows (node, fp, more) within ``distance`` bits of fp.

    With ``limit``, fp and the fingerprints in more must also differ by no more bits than this in all. With ``turns``, each of
    fp and the fingerprints in more, as many in all, finds pairs within ``distance``, all in one job. With ``probed``, only
    pairs within that many bits are found for certain, those up to ``distance`` where they agree in a partition.
    """
    spark = nodes.sparkSession
    total = nodes.count()
    if total < 2:
        return spark.createDataFrame([], "a long, b long")
    with_more = ["more"] if limit else []
    seen = bounded_sample(nodes.select("fp", "node", *with_more), sample, "fp", "node")
    payload = ["node", "fp", *with_more]
    all_fps, rows = [F.col("fp"), *[F.col("more")[i] for i in range(turns - 1)]], None
    for turn in range(turns):
        marks = np.array([r.more[turn - 1] if turn else r.fp for r in seen], dtype=np.int64)
        more = F.array(*all_fps[:turn], *all_fps[turn + 1 :])
        turned = nodes.withColumns({"fp": all_fps[turn], "more": more}) if turns > 1 else nodes
        parts = plan(marks, total, distance if probed is None else probed, fewest)
        entries = [_entries(bits, most, 64 * turn + part) for part, (bits, most) in enumerate(parts) if most >= 0]
        found = turned.select(*payload, F.inline(F.concat(*entries)))
        rows = found if rows is None else rows.unionByName(found)
    # how many blocks a large value needs: the index rows and all that ask
    sizes = (
        rows.groupBy("part", "value")
        .agg(F.sum(1 - F.col("probe")).alias("n_index"), F.count("*").alias("n_asks"))
        .where(f"n_index > 0 and (n_index > {block} or n_asks > {4 * block})")
        .select("part", "value", F.ceil(F.col("n_index") / block).cast("int").alias("gi"), F.ceil(F.col("n_asks") / (4 * block)).cast("int").alias("gq"))
    )
    sizes = saved(sizes, "sizes")
    h = F.xxhash64(F.lit(7), F.col("node"))
    dealt = rows.join(sizes, ["part", "value"], "left").withColumns({"gi": F.coalesce("gi", F.lit(1)), "gq": F.coalesce("gq", F.lit(1))})
    dealt = dealt.withColumns({"bi": F.pmod(h, F.col("gi")).cast("int"), "bq": F.pmod(h, F.col("gq")).cast("int")})
    # of a cut value, an index row meets each block that asks, and each row that asks meets each index block
    whole = (F.col("gi") == 1) & (F.col("gq") == 1)
    held = F.transform(F.sequence(F.lit(0), F.col("gq") - 1), lambda q: F.struct(F.lit(0).alias("side"), F.xxhash64("part", "value", "bi", q).alias("gid")))
    asks = F.transform(F.sequence(F.lit(0), F.col("gi") - 1), lambda i: F.struct(F.lit(1).alias("side"), F.xxhash64("part", "value", i, "bq").alias("gid")))
    one = F.array(F.struct(F.col("probe").alias("side"), F.xxhash64("part", "value").alias("gid")))
    spots = F.when(whole, one).when(F.col("probe") == 0, F.concat(held, asks)).otherwise(asks)
    spread = dealt.select(*payload, F.inline(spots)).withColumnRenamed("side", "probe")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return spread.repartition(n, "gid").sortWithinPartitions("gid", "probe").mapInArrow(_verify(distance, limit), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """One row (id, fp, component_id) for each row of docs.

    Null, empty and blank texts have fingerprint zero, which links like any other. Texts of fewer words than a shingle
    are one shingle. Rows with equal ids each get a row; a null id is never the smallest of a component unless all are
    null. An empty table gives an empty result. Only the two named columns are read, whatever else the table holds.
    """
    marked = saved(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("node", F.col("fp"))
    nodes = saved(nodes, "nodes")
    edges = saved(links(nodes.select("node", "fp"), distance, block=block), "links")
    found = connected_components(edges, "a", "b")
    root = found.join(nodes.select("node", "least"), "node")
    best = root.groupBy("component").agg(F.min("least").alias("best"), F.count("*").alias("n"))
    limit = frequent_limit(marked.count())
    named = join_counted(root.select("node", "component"), best, "component", "n", limit, "node")
    whole = nodes.join(named, "node", "left").select("fp", "n", F.coalesce("best", "least").alias("component_id"))
    return join_counted(marked, whole, "fp", "n", limit, "id").select("id", "fp", "component_id")


#: Sets of five-word shingles with a similarity of 0.8 differ by 39 of 256 bits on average (a share of two ninths of the
#: shingles differs, an angle of 27 degrees), with a deviation of 6: 64 bits lose none in practice. Partitions are planned so
#: that each of the four fingerprints finds what differs by at most 8 of its 64 bits for certain, and with FEWEST partitions or
#: more some partition agrees for other such pairs too: by the model one in 1,400 at most isn't offered.
WORDS, LEAST, PROBED, FEWEST, DISTANCE, EXTRA, CLOSE, LIMIT, WIDE_BLOCK = 5, 0.8, 8, 4, 20, 3, 52, 64, 8_000
#: Nodes, and bytes of their sets, whose pairs with those of another block meet in one group.
MEET_NODES, MEET_BYTES = 500, 32 << 20


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x.as_py(), words).tobytes() for x in b.column("t")]
            sizes = pa.array(map(len, sets), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("node"), sizes, pa.array(sets, pa.binary())], names=["node", "size", "t"])

    return run


def _exact(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sets = None, {}
        for t in batches:
            a, b = (t.column(c).to_pylist() for c in ("a", "b"))
            places = list(zip(t.column("left").to_pylist(), t.column("right").to_pylist(), strict=True))
            keep_a, keep_b, at = [], [], 0
            while at < len(a):
                if places[at] != group:
                    group, sets = places[at], {}
                if b[at] is None:  # sets of a group come before its pairs
                    sets[a[at]] = np.frombuffer(t.column("t")[at].as_py(), dtype="<u8")
                    at += 1
                    continue
                end = at + 1
                while end < len(a) and b[end] == b[at] and places[end] == group:
                    end += 1
                mine, others = sets[b[at]], [sets[x] for x in a[at:end]]
                lengths = np.array([len(x) for x in others])
                both = np.array([len(np.intersect1d(others[0], mine, assume_unique=True))]) if len(others) == 1 else _shared(mine, others, lengths)
                near = np.flatnonzero(both >= least * (len(mine) + lengths - both) - 1e-9)
                keep_a += [a[at + i] for i in near]
                keep_b += [b[at]] * len(near)
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64())], names=["a", "b"])

    return run


def _shared(mine: np.ndarray, others: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
    """How many elements each of the others has in common with mine; all in ascending order."""
    joined = np.concatenate(others)
    if not len(mine):
        return np.zeros(len(others), dtype=np.int64)
    hit = mine[np.minimum(np.searchsorted(mine, joined), len(mine) - 1)] == joined
    ends = np.cumsum(lengths)
    sums = np.concatenate([[0], np.cumsum(hit)])
    return sums[ends] - sums[ends - lengths]


def similar_pairs(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, words: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose texts' sets of shingles have a Jaccard similarity of at least ``least``.

    A node (node, least, key) has the text of the row (id, key, t) with its id and key. Sets of shingles are made once for
    each node in a pair. Nodes of a dense group mostly have the same smallest neighbour; they are dealt to blocks of
    bounded size by it, and a pair goes to the group of its two blocks, which gets each set that it needs once.
    """
    spark = pairs.sparkSession
    pairs = saved(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    hubs = saved(both.groupBy("node").agg(F.min("other").alias("m"), F.count("*").alias("n")).select("node", F.least("node", "m").alias("hub"), "n"), "hubs")
    asked = nodes.join(hubs, "node").select("node", "least", F.col("key").alias("of"))
    texts = rows.join(asked, (F.col("key") == F.col("of")) & F.col("id").eqNullSafe(F.col("least"))).select("node", "t")
    texts = saved(texts.dropDuplicates(["node"]).mapInArrow(_sets(words), "node long, size long, t binary"), "shingles")
    sized = hubs.join(texts.select("node", "size"), "node")
    blocks = sized.groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / MEET_NODES, F.sum("size") / MEET_BYTES)).cast("int").alias("g"), F.count("*").alias("nodes"))
    place = F.xxhash64("hub", F.pmod(F.xxhash64("node"), F.greatest("g", F.lit(1))))
    limit = frequent_limit(2 * pairs.count())
    places = saved(join_counted(hubs, blocks, "hub", "nodes", limit, "node").select("node", "n", place.alias("place")), "places")
    left, right = (places.select(F.col("node").alias(c), "n", F.col("place").alias(p)) for c, p in (("a", "left"), ("b", "right")))
    dealt = join_counted(join_counted(pairs, left, "a", "n", limit, "b"), right, "b", "n", limit, "a")
    swap = F.col("left") > F.col("right")  # of two blocks' pairs, all go to one group
    dealt = saved(dealt.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b")), "pairs")
    needed = dealt.select("left", "right", F.col("a").alias("node")).unionByName(dealt.select("left", "right", F.col("b").alias("node"))).distinct()
    sets = needed.join(texts, "node").select("left", "right", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "t")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    met = sets.unionByName(dealt.select("left", "right", "a", "b", F.lit(None).cast("binary").alias("t")))
    met = met.repartition(n, "left", "right").sortWithinPartitions("left", "right", F.asc_nulls_first("b"), "a")
    return met.mapInArrow(_exact(least), "a long, b long")


def _linked(limit: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "gid"):
            gid, node, part, side = (t.column(c).to_numpy() for c in ("gid", "node", "part", "side"))
            fps = np.column_stack([t.column("fp").to_numpy(), matrix(t.column("more"))]).view(np.uint64)
            texts, a, b = t.column("t"), [], []
            for lo, hi in group_slices(gid):
                one = lo + np.flatnonzero(side[lo:hi] == 0)
                two = lo + np.flatnonzero(side[lo:hi] == 1)
                within = not len(two)  # a block with itself
                two = one if within else two
                sets = {}
                _, group = np.unique(part[lo:hi], return_inverse=True)  # what is known to be linked

                def held(i):
                    if i not in sets:
                        sets[i] = np.frombuffer(texts[int(i)].as_py(), dtype="<u8")
                    return sets[i]

                for n, i in enumerate(one):
                    others = two[n + 1 :] if within else two
                    others = others[group[others - lo] != group[i - lo]]
                    far = np.bitwise_count(fps[others] ^ fps[i]).sum(axis=1, dtype=np.int64)
                    others = others[far <= limit]
                    if not len(others):
                        continue
                    mine, rest = held(i), [held(j) for j in others]
                    lengths = np.array([len(x) for x in rest])
                    both = _shared(mine, rest, lengths)
                    for j in others[both >= least * (len(mine) + lengths - both) - 1e-9]:
                        if group[j - lo] != group[i - lo]:
                            group[group == group[j - lo]] = group[i - lo]
                            a.append(node[i])
                            b.append(node[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def similar_between(offered: DataFrame, nodes: DataFrame, rows: DataFrame, words: int, least: float, limit: int) -> DataFrame:
    """Edges (a, b) that connect what pairs of nodes of different parts with a Jaccard similarity of at least ``least`` connect.

    Pairs are looked at where ``offered`` connects both and their fingerprints differ by no more than ``limit`` bits in all. A
    node (node, least, key, fp, more, part) has the text of the row (id, key, t) with its id and key; nodes of a part are linked
    already. Components of one part need no work. Of the others, a large part has blocks of its own, which needn't meet each
    other, and small parts share blocks; each node's set goes to the groups of its block.
    """
    spark = nodes.sparkSession
    placed = saved(nodes.join(connected_components(offered, "a", "b"), "node"), "placed")
    kinds = placed.groupBy("component").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("n"))
    limit_rows = frequent_limit(placed.count())
    opened = join_counted(placed, kinds.select("component", "n", (F.col("p") < F.col("q")).alias("open")), "component", "n", limit_rows, "node").where("open").drop("open")
    opened = saved(opened, "placed")
    asked = opened.select("node", "least", F.col("key").alias("of"))
    texts = rows.join(asked, (F.col("key") == F.col("of")) & F.col("id").eqNullSafe(F.col("least"))).select("node", "t")
    texts = saved(texts.dropDuplicates(["node"]).mapInArrow(_sets(words), "node long, size long, t binary"), "shingles")
    sized = opened.select("node", "component", "part").join(texts.select("node", "size"), "node")
    blocks = F.ceil(F.greatest(F.sum("m") / MEET_NODES, F.sum("size") / MEET_BYTES)).cast("int")
    parts = saved(sized.withColumn("m", F.lit(1)).groupBy("component", "part").agg(F.count("*").alias("m"), F.sum("size").alias("size")), "parts")
    large = (F.col("m") > MEET_NODES) | (F.col("size") > MEET_BYTES)
    own = parts.where(large).groupBy("part").agg(blocks.alias("g"), F.sum("m").alias("n"))
    shared = parts.where(~large).groupBy("component").agg(blocks.alias("h"), F.sum("m").alias("n"))
    limit_rows = frequent_limit(opened.count())
    known = join_counted(opened.select("node", "component", "part"), own, "part", "n", limit_rows, "node")
    known = join_counted(known, shared, "component", "n", limit_rows, "node")
    # of a large part, the blocks are its own; of small ones, all nodes lie in one
    owner = F.when(F.col("g").isNotNull(), F.col("part"))
    block = F.coalesce(F.pmod(F.xxhash64("node"), F.col("g")), F.pmod(F.xxhash64("part"), F.col("h")))
    spots = saved(known.select("node", "component", owner.alias("owner"), F.xxhash64("component", F.coalesce(owner, F.lit(-1)), block).alias("block")), "spots")
    each = saved(spots.select("component", "block", "owner").distinct(), "blocks")
    other = each.select("component", F.col("block").alias("with"), F.col("owner").alias("of"))
    apart = F.coalesce(F.col("owner") != F.col("of"), F.lit(True))
    met = each.join(other, "component").where((F.col("block") <= F.col("with")) & apart).select("block", "with", F.xxhash64("block", "with").alias("gid"))
    met = saved(met, "met")
    sides = met.select("block", "gid", F.lit(0).alias("side")).unionByName(met.where(F.col("block") != F.col("with")).select(F.col("with").alias("block"), "gid", F.lit(1).alias("side")))
    dealt = spots.select("node", "block").join(sides, "block").drop("block")
    held = opened.select("node", "part", "fp", "more").join(texts.select("node", "t"), "node")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    groups = dealt.join(held, "node").repartition(n, "gid").sortWithinPartitions("gid", "node")
    return groups.mapInArrow(_linked(limit, least), "a long, b long")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest id stays.

    Near-duplicates have at least 0.8 of their five-word shingles in common (Jaccard of the sets, computed for each
    candidate pair); texts without words are copies of each other.

    Different texts that share an id are rows of their own; of rows that repeat both id and text one stays. Rows with a
    null id can't be named by a component; they all stay.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("t"))
    marked = saved(set_fingerprints(rows, WORDS, EXTRA), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    nodes = marked.groupBy("fp", "more", "mark").agg(first).select("fp", "more", F.col("first.id").alias("least"), F.col("first.key").alias("key"))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    close = links(nodes, DISTANCE, CLOSE, block=WIDE_BLOCK, probed=PROBED, fewest=FEWEST)
    close = saved(similar_pairs(close, nodes, rows, WORDS, LEAST), "links")
    parts = connected_components(close, "a", "b")
    parted = saved(nodes.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component"), "nodes")
    offered = links(parted, DISTANCE, LIMIT, block=WIDE_BLOCK, turns=1 + EXTRA, probed=PROBED, fewest=FEWEST)
    edges = close.unionByName(similar_between(saved(offered, "offered"), parted, rows, WORDS, LEAST, LIMIT))
    best = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), "key")).alias("best")
    whole = nodes.join(connected_components(edges, "a", "b"), "node", "left").groupBy(F.coalesce("component", "node")).agg(best)
    whole = whole.select(F.col("best.id").alias("__id"), F.col("best.key").alias("__key"))
    stays = (F.col(id_col) == F.col("__id")) & (F.xxhash64(text_col) == F.col("__key"))
    kept = docs.join(whole, stays, "left_semi").withColumn("__key", F.xxhash64(text_col)).dropDuplicates([id_col, "__key"]).drop("__key")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
