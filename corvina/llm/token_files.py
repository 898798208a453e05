"""Token ids in binary files of independent zstandard frames with a seek table.

A file holds the documents of one range of ids in ascending order. Its frames each hold the ids (little-endian unsigned
32-bit) of some documents and can be decompressed on their own. The last data frame is a directory: for each document its
id, its frame, the place of its first id in the frame, its number of ids, and whether its id is null. A skippable frame ends the file with the
seek table of zstandard's seekable format: for each frame its compressed size, its size and the low 32 bits of its XXH64,
then the number of frames, a descriptor and a magic number. A reader takes the table from the file's end, then the
directory, then only the frames of the documents asked for, and checks each frame's sum.

Files are written by tasks under names of their own and become known only through the manifest that Spark commits, so a
task that is run twice, or lost half way, does no harm.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.llm.common import task_count, text_bytes
from corvina.llm.encoding import encoder
from corvina.session import fresh_path, saved

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, FOOTER_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Ids of a frame, at least, before the next is begun.
FRAME_IDS = 1 << 16
#: Bytes of text for each file, where the configured number of tasks would give more.
FILE_BYTES = 64 << 20
_DIRECTORY = np.dtype([("doc_id", "<i8"), ("frame", "<u4"), ("at", "<u4"), ("n", "<u4"), ("none", "u1")])
_TEXTS = 256


def _open(path: str):
    store, place = fs.FileSystem.from_uri(path)
    return store, place


class FrameWriter:
    """Writes frames to a binary stream and the seek table at the end."""

    def __init__(self, stream, level: int = 3):
        self.stream, self.pack, self.table = stream, zstandard.ZstdCompressor(level=level), []

    def frame(self, data: bytes) -> int:
        packed = self.pack.compress(data)
        self.stream.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        return len(self.table) - 1

    def finish(self) -> None:
        rows = b"".join(struct.pack("<III", *t) for t in self.table)
        footer = struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, FOOTER_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(rows) + len(footer)) + rows + footer)


class FrameReader:
    """Reads single frames of a file by its seek table."""

    def __init__(self, source):
        self.source, end = source, source.size()
        source.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != FOOTER_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table")
        source.seek(end - 9 - 12 * n)
        self.table = np.frombuffer(source.read(12 * n), dtype="<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        self.unpack = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        self.source.seek(int(self.starts[k]))
        data = self.unpack.decompress(self.source.read(int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def directory(self) -> np.ndarray:
        return np.frombuffer(self.frame(len(self.table) - 1), dtype=_DIRECTORY)

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in the file's order; with ``wanted``, only these documents and only their frames."""
        entries = self.directory()
        if wanted is not None:
            entries = entries[np.isin(entries["doc_id"], np.fromiter(wanted, dtype=np.int64)) & (entries["none"] == 0)]
        held, ids = -1, np.zeros(0, "<u4")
        for e in entries:
            if e["frame"] != held:
                held, ids = int(e["frame"]), np.frombuffer(self.frame(int(e["frame"])), dtype="<u4")
            yield None if e["none"] else int(e["doc_id"]), ids[e["at"] : e["at"] + e["n"]]


def _write(tokenizer: str, folder: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tool = TaskContext.get().partitionId(), encoder(tokenizer)
        store, place = _open(folder)
        store.create_dir(place, recursive=True)
        name = f"ids-{part:06d}-{uuid.uuid4().hex}.zst"
        total, entries, held, waiting = 0, [], [], 0
        with store.open_output_stream(f"{place}/{name}", compression=None) as stream:
            out = FrameWriter(stream)

            def flush() -> None:
                nonlocal held, waiting
                if held:
                    out.frame(b"".join(held))
                held, waiting = [], 0

            for b in batches:
                for lo in range(0, b.num_rows, _TEXTS):
                    docs, texts = (b.column(c).slice(lo, _TEXTS).to_pylist() for c in ("doc_id", "text"))
                    for doc, ids in zip(docs, tool.encode_all([t or "" for t in texts]), strict=True):
                        ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                        entries.append((doc or 0, len(out.table), waiting, len(ids), doc is None))
                        held.append(ids.tobytes())
                        waiting += len(ids)
                        total += len(ids)
                        if waiting >= FRAME_IDS:
                            flush()
            flush()
            out.frame(np.array(entries, dtype=_DIRECTORY).tobytes())
            out.finish()
        columns = {"part": [part], "file": [f"{folder}/{name}"], "n_docs": [len(entries)], "n_ids": [total]}
        known = [e[0] for e in entries if not e[4]]
        columns |= {"first_doc": [known[0] if known else None], "last_doc": [known[-1] if known else None]}
        schema = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64())])
        yield pa.RecordBatch.from_pydict(columns, schema=schema)

    return run


def write_ids(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Writes files into ``folder`` (the shared folder if none is named) and returns the manifest: a row for each file.

    Columns: part (ascending with the ids), file, n_docs, n_ids, first_doc, last_doc. Null and empty texts are ``end_id``
    alone. Rows with equal ids are written each, next to each other, in the order of their texts' hashes. Rows with a null
    id come before all others, and count as repeated ids do. An empty table gives files without documents, or none.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "ids")
    n = task_count(spark, text_bytes(docs, text_col), FILE_BYTES)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ordered = named.repartitionByRange(n, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    schema = "part int, file string, n_docs long, n_ids long, first_doc long, last_doc long"
    return saved(ordered.mapInArrow(_write(tokenizer, folder, end_id), schema), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for file, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
            store, place = _open(file)
            with store.open_input_file(place) as source:
                rows = []
                for doc, ids in FrameReader(source).documents():
                    rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; start counts the ids of all before it."""
    n = max(manifest.count(), 1)  # a task for each file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    placed = manifest.where("n_docs > 0").select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    return placed.repartition(n).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(manifest: DataFrame, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of some documents; only their files' directories and their frames are read."""
    wanted = sorted({int(d) for d in doc_ids})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column("file").to_pylist():
                store, place = _open(file)
                with store.open_input_file(place) as source:
                    got = list(FrameReader(source).documents(wanted))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1].astype(np.int64) for g in got], pa.list_(pa.int64()))], names=["doc_id", "ids"]
                )

    spans = None
    for d in wanted:
        hit = F.lit(d).between(F.col("first_doc"), F.col("last_doc"))
        spans = hit if spans is None else spans | hit
    return manifest.where(spans if spans is not None else F.lit(False)).select("file").mapInArrow(run, "doc_id long, ids array<bigint>")
