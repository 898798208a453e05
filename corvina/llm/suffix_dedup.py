"""Exact removal of repeated byte strings with suffix arrays in shards.

Texts are packed into blocks of bounded size (a bucketed table in the shared folder); a text that is longer than a block is
looked at in slices that overlap by a window less one byte. In every window of ``width`` bytes one short string, the one
with the smallest hash, is its anchor; equal windows have equal anchors at equal places, whichever document they are in.
So only windows whose anchor also occurs in another document can repeat:

1. each slice tells, by ranges of anchor hashes, which anchors it has; a range tells every slice which of its anchors
   other documents have too, and which of them are hot, that is, occur very often;
2. each slice cuts out the stretches of windows around its shared anchors, equal stretches once, and sends them to the
   shard of their anchor, so that equal windows meet in one shard. Stretches of a hot anchor are sent as single windows,
   each to the shard of its own hash, so that no anchor fills a shard;
3. where a shard has several different stretches of an anchor, it builds their suffix array by induced sorting and the
   permuted common prefixes; neighbours that share ``width`` bytes are one repeated window, whose smallest document is
   the one that keeps it. The windows of an anchor's only stretch belong to the smallest document that sent it;
4. each slice cuts the same stretches again, learns the smallest document of its windows and removes what lies in windows
   of smaller documents.

The anchors only narrow down what is sorted: no repeat is missed, and hash collisions merely send more. Copies of a
stretch are merged in each slice before anything is shuffled; ranges and shards are as many as the input's size asks for.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvina.llm.common import group_slices, task_count, text_bytes, whole_groups
from corvina.llm.suffix_sort import permuted_common_prefixes, suffix_array
from corvina.session import fresh_path, saved

BLOCK_BYTES, BUCKET_BYTES, SHARD_BYTES, RANGE_BYTES = 1 << 20, 8 << 20, 2 << 20, 32 << 20
#: Occurrences that make an anchor hot.
HOT = 30_000
#: A slice's number is its block's, shifted, and its place in the block.
SLICE_BITS = 16
NO_DOC = np.iinfo(np.int64).max  # stands for a null id, and is larger than all
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd bases of the rolling hashes


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _prefix(t: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (byte + 1) * base**i before each position, and the powers that take them back to zero."""
    sums = np.zeros(len(t) + 1, dtype=np.uint64)
    np.cumsum((t.astype(np.uint64) + np.uint64(1)) * _powers(base, len(t)), out=sums[1:])
    return sums, _powers(_inverse(base), len(t) + 1)


class SliceView:
    """A slice's stretches: for each, the document, the first window, the number of windows and the anchor's hash."""

    def __init__(self, t: np.ndarray, lengths: np.ndarray, width: int, anchor: int):
        self.t, self.width, n = t, width, len(t)
        self.ends = np.cumsum(lengths)
        self.doc = np.zeros(0, np.int64)
        self.start = self.count = self.doc
        self.hash = np.zeros(0, np.uint64)
        self.sums = None
        if n < width:
            return
        sums, back = self.sums = _prefix(t, _B1)
        grams = _mix((sums[anchor:] - sums[:-anchor]) * back[: n - anchor + 1])
        # the smallest of each window, ties to the left: the hash's upper half, then the place
        low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        span, m = width - anchor + 1, 1
        while 2 * m <= span:
            low, m = np.minimum(low[:-m], low[m:]), 2 * m
        if span > m:
            low = np.minimum(low[: len(low) - (span - m)], low[span - m :])
        place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        owner = np.repeat(np.arange(len(lengths)), lengths)[: n - width + 1]
        valid = np.arange(n - width + 1) + width <= self.ends[owner]
        change = np.ones(len(place), dtype=bool)
        change[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(change)
        count = np.diff(np.append(first, len(place)))
        keep = valid[first]
        self.start, self.count = first[keep], count[keep]
        # anchors are smallest hashes, so they are mixed again: ranges of hashes then hold equally many
        self.doc, self.hash = owner[self.start], _mix(grams[place[self.start]])

    def marks(self, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the bytes of stretches."""
        end = start + count + self.width - 1
        sums2, back2 = _prefix(self.t, _B2)
        sums, back = self.sums
        one = (sums[end] - sums[start]) * back[start]
        two = (sums2[end] - sums2[start]) * back2[start]
        return _mix(one + (end - start).astype(np.uint64)), _mix(two)


def _raw(packed: pa.BinaryScalar, lengths: np.ndarray) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed.as_py(), max_output_size=int(lengths.sum()))


def _slices(text: np.ndarray, lengths: np.ndarray, width: int, anchor: int, most: int) -> Iterator[tuple[int, int, SliceView]]:
    """(number, first byte, view) of a block's slices: the block itself, or parts of its one long text."""
    if len(lengths) > 1 or len(text) <= most:
        yield 0, 0, SliceView(text, lengths, width, anchor)
        return
    for k, lo in enumerate(range(0, len(text) - width + 1, most)):
        part = text[lo : lo + most + width - 1]
        yield k, lo, SliceView(part, np.array([len(part)]), width, anchor)


def _block(batch: pa.RecordBatch | pa.Table, row: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(block, ids, lengths, text)."""
    ids, lengths = (np.array(batch.column(c)[row].as_py(), dtype=np.int64) for c in ("ids", "lengths"))
    return batch.column("block")[row].as_py(), ids, lengths, np.frombuffer(_raw(batch.column("text")[row], lengths), np.uint8)


def _block_schema(rest: T.StructType) -> T.StructType:
    kinds = [("block", T.LongType()), ("rest", T.ArrayType(rest)), ("ids", T.ArrayType(T.LongType())), ("lengths", T.ArrayType(T.LongType())), ("text", T.BinaryType())]
    return T.StructType([T.StructField(n, k) for n, k in kinds])


def _blocks(block_bytes: int):
    """Rows of some texts each; their bytes are compressed, as they are moved once and read three times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, ids, texts, size, pack = TaskContext.get().partitionId(), 0, [], [], [], 0, zstandard.ZstdCompressor(level=3)

        def told(kind: pa.DataType) -> pa.RecordBatch:
            nonlocal number, held, ids, texts, size
            row = {"block": [(part << 24) + number], "rest": [held], "ids": [ids], "lengths": [[len(x) for x in texts]], "text": [pack.compress(b"".join(texts))]}
            number, held, ids, texts, size = number + 1, [], [], [], 0
            kinds = [("block", pa.int64()), ("rest", pa.list_(kind)), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("text", pa.binary())]
            return pa.RecordBatch.from_pydict(row, schema=pa.schema(kinds))

        kind = None
        for b in batches:
            kind = b.schema.field("rest").type
            for rest, doc, text in zip(b.column("rest").to_pylist(), b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if texts and size + len(raw) > block_bytes:
                    yield told(kind)
                held.append(rest)
                ids.append(NO_DOC if doc is None else doc)
                texts.append(raw)
                size += len(raw)
        if texts:
            yield told(kind)

    return run


def _short(h: np.ndarray, base: int, step: int) -> bytes:
    """Five bytes of each hash, counted from its range's start: ranges are small, so other hashes hardly ever look alike."""
    low = (h - np.uint64(base)) >> np.uint64(max(0, step.bit_length() - 40))
    return np.ascontiguousarray(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _tell_anchors(width: int, anchor: int, most: int, ranges: int):
    step = (1 << 64) // ranges + 1
    bounds = np.array([r * step for r in range(1, ranges)], dtype=np.uint64)
    kinds = pa.schema([("range", pa.int32()), ("slice", pa.int64()), ("hashes", pa.binary()), ("told", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                block, ids, lengths, text = _block(b, row)
                for k, _, v in _slices(text, lengths, width, anchor, most):
                    mine = ids[v.doc]
                    own, at, times = np.unique(v.hash, return_inverse=True, return_counts=True)
                    least, last = np.full(len(own), NO_DOC), np.full(len(own), -NO_DOC)
                    np.minimum.at(least, at, mine)
                    np.maximum.at(last, at, mine)
                    # how often the anchor occurs, and in the last bit whether in several documents
                    told = (2 * np.minimum(times, 127) + (least != last)).astype(np.uint8)
                    cuts = np.searchsorted(own, bounds)
                    parts = [(r, h, x) for r, (h, x) in enumerate(zip(np.split(own, cuts), np.split(told, cuts), strict=True)) if len(h)]
                    cols = {"range": [p[0] for p in parts], "slice": [(block << SLICE_BITS) + k] * len(parts)}
                    cols |= {"hashes": [_short(p[1], p[0] * step, step) for p in parts], "told": [p[2].tobytes() for p in parts]}
                    yield pa.RecordBatch.from_pydict(cols, schema=kinds)

    return run


_MASKS = pa.schema([("slice", pa.int64()), ("range", pa.int32()), ("shared", pa.binary()), ("hot", pa.binary()), ("n", pa.int32())])
_ASKS = pa.schema([("slice", pa.int64()), ("shard", pa.int32()), ("bytes", pa.binary()), ("sizes", pa.binary()), ("docs", pa.binary()), ("tags", pa.binary())])


def _shared_anchors(hashes: list[bytes], told: list[bytes], hot: int) -> tuple[list[bytes], list[bytes]]:
    """For each slice of a range, as bits, which of its anchors other documents have too, and which of these are hot.

    A range is the largest thing that is held at once, so what isn't needed any more goes at once.
    """
    sizes = np.array([len(x) // 5 for x in hashes])
    h = _long(b"".join(hashes))
    order = np.argsort(h, kind="stable")
    h = h[order]
    new = np.ones(len(h), dtype=bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    del h
    cut = np.flatnonzero(new)
    of = np.cumsum(new, dtype=np.int32) - 1  # the anchor of each row, in sorted order
    del new
    seen = np.frombuffer(b"".join(told), np.uint8)[order]
    several = np.bincount(of, minlength=len(cut)) > 1
    several |= np.maximum.reduceat(seen & 1, cut) > 0
    often = several & (np.add.reduceat(seen >> 1, cut, dtype=np.int64) >= hot)
    ends, masks = np.cumsum(sizes)[:-1], []
    for which in (several, often):
        flags = np.empty(len(order), dtype=bool)
        flags[order] = which[of]
        masks.append([np.packbits(x).tobytes() for x in np.split(flags, ends)])
    return masks[0], masks[1]


def _share(hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "range"):
            ranges = t.column("range").to_numpy()
            for lo, hi in group_slices(ranges):
                part = t.slice(lo, hi - lo)
                hashes = part.column("hashes").to_pylist()
                shared, often = _shared_anchors(hashes, part.column("told").to_pylist(), hot)
                cols = {"slice": part.column("slice").to_pylist(), "range": [int(ranges[lo])] * (hi - lo), "shared": shared, "hot": often, "n": [len(x) // 5 for x in hashes]}
                yield pa.RecordBatch.from_pydict(cols, schema=_MASKS)

    return run


class Stretches:
    """The stretches around a slice's shared anchors; ``which`` numbers the different ones, in the order of their shards."""

    def __init__(self, v: SliceView, masks: list[dict], shards: int):
        masks = sorted(masks, key=lambda m: m["range"])
        shared, hot = (np.concatenate([np.unpackbits(np.frombuffer(m[c], np.uint8), count=m["n"]) for m in masks]).astype(bool) for c in ("shared", "hot"))
        _, at = np.unique(v.hash, return_inverse=True)
        live = shared[at]
        start, count, doc, key, hot = v.start[live], v.count[live], v.doc[live], v.hash[live], hot[at[live]]
        if hot.any():  # single windows
            n = np.where(hot, count, 1)
            of = np.repeat(np.arange(len(n)), n)
            start = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            count, doc, key, hot = np.where(hot, 1, count)[of], doc[of], key[of], hot[of]
        self.start, self.count, self.doc = start, count, doc
        if not len(start):
            return
        one, two = v.marks(start, count)
        key = _mix(np.where(hot, one, key) ^ _B2)
        shard = (key % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((two, one, shard))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]) | (shard[order][1:] != shard[order][:-1])
        self.which = np.empty(len(order), dtype=np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.heads = order[new]
        self.sizes = count[self.heads] + v.width - 1
        self.shard, self.tag = shard[self.heads], (key >> np.uint64(32)).astype("<u4")[self.heads]


def _by_slice(rows: list[dict] | None) -> dict[int, list[dict]]:
    out: dict[int, list[dict]] = {}
    for r in rows or []:
        out.setdefault(r["slice"], []).append(r)
    return out


def _cut_out(width: int, anchor: int, most: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                masks = _by_slice(b.column("masks")[row].as_py())
                block, ids, lengths, text = _block(b, row)
                for k, _, v in _slices(text, lengths, width, anchor, most):
                    number = (block << SLICE_BITS) + k
                    if number not in masks:
                        continue
                    s = Stretches(v, masks[number], shards)
                    if not len(s.start):
                        continue
                    docs = np.full(len(s.heads), NO_DOC)
                    np.minimum.at(docs, s.which, ids[s.doc])
                    ends = np.cumsum(s.sizes)
                    raw = v.t[np.repeat(s.start[s.heads] - (ends - s.sizes), s.sizes) + np.arange(ends[-1])]
                    sizes, cuts = s.sizes.astype("<u2"), group_slices(s.shard)
                    cols = {"slice": [number] * len(cuts), "shard": [int(s.shard[lo]) for lo, _ in cuts]}
                    cols["bytes"] = [raw[ends[lo] - s.sizes[lo] : ends[hi - 1]].tobytes() for lo, hi in cuts]
                    cols |= {c: [x[lo:hi].tobytes() for lo, hi in cuts] for c, x in (("sizes", sizes), ("docs", docs), ("tags", s.tag))}
                    yield pa.RecordBatch.from_pydict(cols, schema=_ASKS)

    return run


def shard_minima(stretches: np.ndarray, sizes: np.ndarray, docs: np.ndarray, width: int) -> np.ndarray:
    """The smallest document of each window (the windows of all stretches, one after another)."""
    sa = suffix_array(stretches)
    plcp = permuted_common_prefixes(stretches, sa, width)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(stretches))
    valid = left >= width
    doc = np.where(valid, np.repeat(docs, sizes), NO_DOC)
    new = plcp[sa] < width
    new[0] = True
    cut = np.flatnonzero(new)
    least = np.minimum.reduceat(doc[sa], cut)
    out = np.empty(len(stretches), dtype=np.int64)
    out[sa] = np.repeat(least, np.diff(np.append(cut, len(sa))))
    return out[valid]


def _shard_replies(part: pa.Table, width: int) -> list[bytes]:
    """For each row of a shard the smallest documents of its stretches' windows."""
    known: dict[bytes, int] = {}
    first: list[int] = []
    tags: list[int] = []
    asked: list[list[int]] = []
    rows = zip(*(part.column(c).to_pylist() for c in ("bytes", "sizes", "docs", "tags")), strict=True)
    for data, sizes, docs, marks in rows:
        at, numbers = 0, []
        for size, doc, tag in zip(np.frombuffer(sizes, "<u2").tolist(), np.frombuffer(docs, "<i8").tolist(), np.frombuffer(marks, "<u4").tolist(), strict=True):
            k = known.setdefault(data[at : at + size], len(known))
            at += size
            if k == len(first):
                first.append(doc)
                tags.append(tag)
            elif doc < first[k]:
                first[k] = doc
            numbers.append(k)
        asked.append(numbers)
    pieces, least_doc = list(known), np.array(first, dtype=np.int64)
    n = np.array([len(x) for x in pieces], dtype=np.int64) - width + 1
    ends = np.cumsum(n)
    least = np.repeat(least_doc, n)
    # an anchor's only stretch has no window in common with any other
    _, of, times = np.unique(np.array(tags, dtype=np.uint32), return_inverse=True, return_counts=True)
    several = times[of] > 1
    if several.any():
        which = np.flatnonzero(several)
        found = shard_minima(np.frombuffer(b"".join([pieces[k] for k in which.tolist()]), np.uint8), n[which] + width - 1, least_doc[which], width)
        least[np.repeat(several, n)] = found
    replies = []
    for numbers in asked:
        k = np.array(numbers)
        c = n[k]
        e = np.cumsum(c)
        replies.append(least[np.repeat(ends[k] - c - (e - c), c) + np.arange(e[-1])].tobytes())
    return replies


def _sort_shards(width: int):
    kinds = pa.schema([("slice", pa.int64()), ("shard", pa.int32()), ("least", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "shard"):
            for lo, hi in group_slices(t.column("shard").to_numpy()):
                part = t.slice(lo, hi - lo)
                cols = {"slice": part.column("slice").to_pylist(), "shard": part.column("shard").to_pylist(), "least": _shard_replies(part, width)}
                yield pa.RecordBatch.from_pydict(cols, schema=kinds)

    return run


def _removed(v: SliceView, s: Stretches, ids: np.ndarray, replies: list[dict]) -> np.ndarray:
    """True for the slice's bytes that go."""
    least = np.frombuffer(b"".join([r["least"] for r in sorted(replies, key=lambda r: r["shard"])]), "<i8")
    n = s.sizes - v.width + 1
    first, e = np.cumsum(n) - n, np.cumsum(s.count)
    inner = np.arange(e[-1]) - np.repeat(e - s.count, s.count)
    hit = (np.repeat(s.start, s.count) + inner)[least[np.repeat(first[s.which], s.count) + inner] < np.repeat(ids[s.doc], s.count)]
    gone = np.zeros(len(v.t) + 1, dtype=np.int32)
    gone[hit] += 1  # a window begins at each place once
    gone[hit + v.width] -= 1
    return np.cumsum(gone)[:-1] > 0


def _remove(width: int, anchor: int, most: int, shards: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                block, ids, lengths, text = _block(b, row)
                mask = np.zeros(len(text), dtype=bool)
                replies = _by_slice(b.column("replies")[row].as_py())
                masks = _by_slice(b.column("masks")[row].as_py()) if replies else {}
                for k, lo, v in _slices(text, lengths, width, anchor, most) if replies else ():
                    number = (block << SLICE_BITS) + k
                    if number in replies:
                        mask[lo : lo + len(v.t)] |= _removed(v, Stretches(v, masks[number], shards), ids, replies[number])
                rows, at = [], 0
                for n_bytes in lengths.tolist():
                    m = mask[at : at + n_bytes]
                    kept = text[at : at + n_bytes][~m].tobytes()
                    spans = int(m[:1].sum()) + int((m[1:] & ~m[:-1]).sum())
                    # a cut may part a character; its halves go too
                    rows.append((n_bytes, n_bytes - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
                    at += n_bytes
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("rest")[row].values, *columns], names=["rest", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def repeats(
    docs: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text", width: int = 50, anchor: int = 20, with_text: bool = False,
    block_bytes: int = BLOCK_BYTES, hot: int = HOT,
) -> DataFrame:
    """Rows (rest, n_bytes, n_removed, n_spans, kept_sha256, kept), one for each row of docs; rest has the columns of ``carry``.

    A byte goes if it lies in a string of ``width`` bytes that also starts in a row with a smaller id. Rows with equal ids
    take nothing from each other; a null id is larger than all others. Null texts are empty; texts shorter than ``width``
    lose nothing. A very long text is held whole, but worked on in slices. An empty table gives an empty result.
    """
    if not anchor <= width < 1 << 15:
        raise ValueError("width")
    spark = docs.sparkSession
    total = text_bytes(docs, text_col)
    buckets = min(task_count(spark, total, BUCKET_BYTES), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    named = docs.select(F.struct(*[F.col(c) for c in carry]).alias("rest"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rest = named.schema["rest"].dataType
    name = f"text_blocks_{uuid.uuid4().hex}"
    made = named.mapInArrow(_blocks(block_bytes), _block_schema(rest)).repartition(buckets, "block")
    made.write.bucketBy(buckets, "block").sortBy("block").option("compression", "zstd").option("path", fresh_path(spark, "blocks")).saveAsTable(name)
    try:
        return _without(spark.table(name), rest, width, anchor, block_bytes, hot, total, with_text)
    finally:
        spark.sql(f"drop table if exists {name}")


def _without(blocks: DataFrame, rest: T.StructType, width: int, anchor: int, block_bytes: int, hot: int, total: int, with_text: bool) -> DataFrame:
    """What ``repeats`` returns, saved, from a bucketed table of blocks."""
    spark = blocks.sparkSession
    ranges = max(4, -(-total // RANGE_BYTES))
    shards = task_count(spark, total, SHARD_BYTES)
    of = F.shiftright("slice", SLICE_BITS).alias("block")
    told = blocks.select("block", "ids", "lengths", "text").mapInArrow(_tell_anchors(width, anchor, block_bytes, ranges), "range int, slice long, hashes binary, told binary")
    masks = told.repartition(task_count(spark, total, RANGE_BYTES), "range").sortWithinPartitions("range", "slice")
    masks = masks.mapInArrow(_share(hot), "slice long, range int, shared binary, hot binary, n int")
    masks = saved(masks.groupBy(of).agg(F.collect_list(F.struct("slice", "range", "shared", "hot", "n")).alias("masks")), "masks")
    asks = blocks.join(masks.hint("merge"), "block").select("block", "ids", "lengths", "text", "masks")
    sent = asks.mapInArrow(_cut_out(width, anchor, block_bytes, shards), "slice long, shard int, bytes binary, sizes binary, docs binary, tags binary")
    replies = sent.repartition(shards, "shard").sortWithinPartitions("shard", "slice").mapInArrow(_sort_shards(width), "slice long, shard int, least binary")
    replies = replies.groupBy(of).agg(F.collect_list(F.struct("slice", "shard", "least")).alias("replies"))
    whole = blocks.join(masks.hint("merge"), "block", "left").join(replies.hint("merge"), "block", "left")
    out = T.StructType([T.StructField("rest", rest)])
    for field, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), ("kept", "string")):
        out = out.add(field, kind)
    parted = whole.select("block", "rest", "ids", "lengths", "text", "masks", "replies").mapInArrow(_remove(width, anchor, block_bytes, shards, with_text), out)
    return saved(parted, "parted")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row; see ``repeats``."""
    found = repeats(docs, [id_col], id_col, text_col, width, block_bytes=block_bytes, hot=hot)
    return found.select(F.col("rest")[id_col].cast("long").alias("id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """``docs`` with repeated strings cut from the text; halves of characters that a cut leaves are dropped.

    Null texts stay null.
    """
    marked = docs.withColumn("__null", F.col(text_col).isNull())
    found = repeats(marked, [c for c in marked.columns if c != text_col], id_col, text_col, width, with_text=True)
    kept = F.when(~F.col("rest")["__null"], F.col("kept"))
    return found.select(*[kept.alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns])
