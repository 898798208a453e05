"""Packing of documents into sequences by first-fit decreasing, in randomised groups.

Documents are dealt to groups by a seeded hash of their id and text, and every group is packed on its own, so that groups
are independent tasks. A group holds at most ``4 * GROUP_DOCS`` remainders in memory: where chance, or rows that repeat
both id and text, give it more, it packs what it has and goes on. A document's full stretches of ``capacity`` ids become sequences at once; only the
remainders wait for the group's end. They are placed in decreasing order, each in the first open sequence with room, which
a tournament tree over the free room finds in logarithmic time.

First fit leaves gaps, mostly in the last sequences. The emptiest sequences are therefore cut up to fill the gaps of the
others (pieces of at least ``least_piece`` ids), and what is still far from full is cut at powers of two, where a
sequence needs no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import task_count
from corvina.llm.encoding import encoder

#: Documents of a group, on average.
GROUP_DOCS = 2_048
#: Bytes of text for each task, where the configured number of tasks would give more.
TASK_BYTES = 64 << 20
_TEXTS = 256


class RoomTree:
    """A tournament tree over the free room of bins: each inner node holds the larger room of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.size)

    def place(self, need: int) -> int:
        """The first bin with room for ``need``, which it then has less."""
        room, node = self.room, 1
        if room[1] < need:
            raise ValueError("no bin has room")
        while node < self.size:
            node *= 2
            if room[node] < need:
                node += 1
        at = node - self.size
        room[node] -= need
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return at


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """The items in each bin; no bin is empty."""
    tree = RoomTree(max(1, len(lengths)), capacity)
    bins: list[list[int]] = []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = tree.place(lengths[item])
        if at == len(bins):
            bins.append([])
        bins[at].append(item)
    return bins


def pack(lengths: list[int], capacity: int, least_piece: int = 32) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length) with little padding; every unit of every item is in one piece."""
    bins = [[(i, 0, lengths[i]) for i in b] for b in first_fit_decreasing(lengths, capacity)]
    fill = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda k: (fill[k], k))
    gaps = [k for k in order if capacity - fill[k] >= least_piece]  # the fullest is last
    spare = sum(capacity - fill[k] for k in gaps)
    done = set()
    for donor in order:
        own = capacity - fill[donor]
        if own < least_piece or spare - own < fill[donor]:
            break
        spare -= own
        moved = bins[donor]
        bins[donor], done = [], done | {donor}
        while moved:
            while gaps and (gaps[-1] in done or capacity - fill[gaps[-1]] < least_piece):
                if gaps[-1] not in done:
                    spare -= capacity - fill[gaps[-1]]
                gaps.pop()
            item, start, n = moved.pop()
            if not gaps:  # room is left in crumbs only
                bins[donor].append((item, start, n))
                continue
            to = gaps[-1]
            take = min(n, capacity - fill[to])
            bins[to].append((item, start, take))
            fill[to] += take
            spare -= take
            if take < n:
                moved.append((item, start + take, n - take))
        fill[donor] = sum(p[2] for p in bins[donor])
        if fill[donor]:
            break
    out = []
    for b, n in zip(bins, fill, strict=True):
        if not b:
            continue
        if capacity - n < 2 * least_piece or n & (n - 1) == 0:
            out.append(b)
            continue
        queue, limit = list(reversed(b)), 1 << (n.bit_length() - 1)
        while n:  # cut at the powers of two that n is the sum of
            limit = 1 << (n.bit_length() - 1)
            room, part = limit, []
            while room:
                item, start, length = queue.pop()
                take = min(room, length)
                part.append((item, start, take))
                room -= take
                if take < length:
                    queue.append((item, start + take, length - take))
            out.append(part)
            n -= limit
    return out


def _pack_groups(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, group, number, waiting, rows = encoder(path), None, 0, [], []

        def finish() -> None:
            nonlocal number, waiting
            for seq in pack([len(w[2]) for w in waiting], capacity):
                offset = 0
                for item, start, n in seq:
                    doc, at, ids, total = waiting[item]
                    rows.append((doc, at + start, n, zlib.crc32(ids[start : start + n].tobytes()), total, (group << 32) + number, offset))
                    offset += n
                number += 1
            waiting = []

        def told() -> pa.RecordBatch:
            nonlocal rows
            columns = list(zip(*rows, strict=True)) or [()] * 7
            rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            for lo in range(0, b.num_rows, _TEXTS):
                groups, docs, texts = (b.column(c).slice(lo, _TEXTS).to_pylist() for c in ("grp", "doc_id", "text"))
                for g, doc, ids in zip(groups, docs, tool.encode_all([t or "" for t in texts]), strict=True):
                    if g != group:
                        finish()
                        group, number = g, 0
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    total = len(ids)
                    whole = total - total % capacity
                    for at in range(0, whole, capacity):
                        rows.append((doc, at, capacity, zlib.crc32(ids[at : at + capacity].tobytes()), total, (group << 32) + number, 0))
                        number += 1
                    if whole < total:
                        waiting.append((doc, whole, ids[whole:].copy(), total))
                    if len(waiting) >= 4 * GROUP_DOCS:
                        finish()
            if len(rows) > 10_000:
                yield told()
        finish()
        yield told()

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = 1_024, seed: int = 11
) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one for each piece.

    A document's ids are those of the tokenizers library for ``tokenizer`` (a path that executors can read), then
    ``end_id``. Null and empty texts are the end id alone. Rows with equal ids are documents each; null ids are packed
    like others. Texts of any length are cut at ``capacity``. An empty table gives an empty result. Only the two named
    columns are read.
    """
    total, size = docs.agg(F.count("*"), F.sum(F.octet_length(text_col))).first()
    n = task_count(docs.sparkSession, size or 0, TASK_BYTES)
    groups = max(n, -(-total // GROUP_DOCS))
    h = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.pmod(h, F.lit(groups)).alias("grp"))
    ordered = dealt.repartition(n, "grp").sortWithinPartitions("grp", F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ordered.mapInArrow(_pack_groups(tokenizer, end_id, capacity), schema)
