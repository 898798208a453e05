"""Chunking: one document row becomes many chunk rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions import text as X
from corvina.functions import vector as V
from corvina.functions.text import sentences, tokens


def fixed_windows(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows of ``size`` characters that don't overlap; none for empty texts."""
    full = docs.where(F.length(text_col) > 0).select(F.col(id_col), F.col(text_col), F.explode(F.sequence(F.lit(0), F.floor((F.length(text_col) - 1) / size))).alias("chunk_index"))
    return full.select(id_col, "chunk_index", F.substr(F.col(text_col), (F.col("chunk_index") * size + 1).cast("int"), F.lit(size)).alias("content"))


def sentence_windows(docs: DataFrame, window: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, sentence, window): each sentence and the text of its neighbours on both sides."""
    rows = docs.select(id_col, sentences(F.col(text_col)).alias("s"))
    near = F.transform("s", lambda x, i: F.struct(x.alias("sentence"), F.array_join(F.slice("s", F.greatest(i - window + 1, F.lit(1)), F.least(i, F.lit(window)) + 1 + window), " ").alias("window")))
    return rows.select(id_col, F.posexplode(near).alias("pos", "w")).select(id_col, F.col("pos").cast("long").alias("pos"), "w.sentence", "w.window")


def markdown_sections(docs: DataFrame, levels: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, header, n_lines, content): a section starts at each header of up to so many marks; 0 comes before the first."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("n", "line"))
    head = F.col("line").rlike("^#{1,%d} " % levels)
    place = Window.partitionBy(id_col).orderBy("n")
    cut = lines.withColumn("section", F.sum(head.cast("long")).over(place)).withColumn("header", F.when(head, F.col("line")))
    own = F.sort_array(F.collect_list(F.struct("n", "line")))
    return cut.groupBy(id_col, "section").agg(F.max("header").alias("header"), F.count("*").alias("n_lines"), F.array_join(F.transform(own, lambda x: x["line"]), "\n").alias("content"))


def chunk_order(start: Column, index: Column) -> Column:
    return F.coalesce(start.cast("long"), index.cast("long") * 10_000, F.lit(0).cast("long"))


def gazetteer_match(texts: DataFrame, patterns: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 1) -> DataFrame:
    """(id, name, label), distinct: names of ``patterns`` (lower-cased, up to ``longest`` words) that occur as words of a text."""
    grams = None
    rows = texts.select(id_col, tokens(F.col(text_col)).alias("t"))
    for n in range(1, longest + 1):
        spans = F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i, n=n: F.array_join(F.slice("t", i, n), " ")) if n > 1 else F.col("t")
        part = rows.where(F.size("t") >= n).select(id_col, F.explode(F.array_distinct(spans)).alias("name"))
        grams = part if grams is None else grams.unionByName(part)
    return grams.join(patterns, "name").select(id_col, "name", "label").distinct()


def section_paths(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds the path of the last header at or before each line; lines have (id, n, line)."""
    number = F.regexp_extract("line", r"^(\d+(?:\.\d+)*)[.)]?\s", 1)
    place = Window.partitionBy(id_col).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("own", F.when(F.col("line").rlike(r"^#{1,6} "), F.lit("#")).when(number != "", number))
    counted = marked.withColumn("k", F.sum((F.col("own") == "#").cast("long")).over(place))
    named = counted.withColumn("own", F.when(F.col("own") == "#", F.concat(F.lit("s"), F.col("k").cast("string"))).otherwise(F.col("own")))
    return named.withColumn("section_path", F.last("own", ignorenulls=True).over(place)).drop("own", "k")


# ---- greedy chunkers: sequential inside one document, so they run in Arrow batches of documents ----

# What texts are cut at, the coarsest first.
SEPARATORS = ["\n\n", "\n", " ", ""]


def split_recursively(text: str, size: int, overlap: int, separators: list[str] = SEPARATORS) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most ``size`` characters, cut at the first separator that parts them finely enough.

    Pieces are joined while they fit; the next chunk begins with the last pieces that fit into ``overlap``. Blanks at a
    chunk's ends don't count to it.
    """

    def pieces(lo: int, hi: int, level: int) -> list[tuple[int, int]]:
        if hi - lo <= size:
            return [(lo, hi)]
        sep = separators[level]
        if not sep:
            return [(i, min(hi, i + size)) for i in range(lo, hi, size)]
        out, at = [], lo
        while at < hi:
            cut = text.find(sep, at + 1, hi)
            end = hi if cut < 0 else cut
            out += [(at, end)] if end - at <= size else pieces(at, end, level + 1)
            at = end
        return out

    out: list[tuple[int, int]] = []
    held: list[tuple[int, int]] = []
    for piece in pieces(0, len(text), 0):
        if held and piece[1] - held[0][0] > size:
            out.append((held[0][0], held[-1][1]))
            while held and (held[-1][1] - held[0][0] > overlap or piece[1] - held[0][0] > size):
                held.pop(0)
        held.append(piece)
    if held:
        out.append((held[0][0], held[-1][1]))
    trimmed = []
    for lo, hi in out:
        while lo < hi and text[lo].isspace():
            lo += 1
        while hi > lo and text[hi - 1].isspace():
            hi -= 1
        if lo < hi:
            trimmed.append((lo, hi))
    return trimmed


#: Characters of chunks that a task holds before it hands them on.
HELD = 4_000_000


def _chunks(docs: DataFrame, spans, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("id"), b.column("text")
            rows, held = [], 0
            for n in range(b.num_rows):
                t = texts[n].as_py()
                for k, (lo, hi) in enumerate(spans(t)) if t else ():
                    rows.append((n, k, lo, hi, t[lo:hi]))
                    held += hi - lo
                    if held > HELD:
                        yield _batch(ids, rows)
                        rows, held = [], 0
            if rows:
                yield _batch(ids, rows)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, chunk_index int, start_offset int, end_offset int, content string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _batch(ids: pa.Array, rows: list[tuple[int, int, int, int, str]]) -> pa.RecordBatch:
    at, index, start, end, content = zip(*rows, strict=True)
    columns = [ids.take(pa.array(at, pa.int64())), pa.array(index, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(content, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["id", "chunk_index", "start_offset", "end_offset", "content"])


def chunk_by_size(docs: DataFrame, size: int = 1000, overlap: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, start_offset, end_offset, content); the text from start to end is the content."""
    return _chunks(docs, lambda t: split_recursively(t, size, overlap), id_col, text_col)


def chunk_sections(docs: DataFrame, size: int = 6000, overlap: int = 500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Larger sections, which may also be cut at sentence ends."""
    return _chunks(docs, lambda t: split_recursively(t, size, overlap, ["\n\n", "\n", ". ", " ", ""]), id_col, text_col)


def chunk_parent_child(docs: DataFrame, parent=(2000, 0), child=(500, 100), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Parents, and children with the parent that they are cut from; offsets of children are within the parent."""
    parents = chunk_by_size(docs, *parent, id_col, text_col).withColumn("parent_id", F.concat_ws("_p", F.col(id_col).cast("string"), F.col("chunk_index").cast("string")))
    children = chunk_by_size(parents, *child, "parent_id", "content")
    return parents, children


def pre_segment_spans(text: str, size: int = 8000, overlap: int = 1000, look: int = 500) -> list[tuple[int, int]]:
    """Windows that end, if they can, at an empty line, a newline or a sentence end among their last characters."""
    out, lo = [], 0
    while lo < len(text):
        hi = min(len(text), lo + size)
        if hi < len(text):
            for mark in ("\n\n", "\n", ". "):
                at = text.rfind(mark, max(lo + 1, hi - look), hi)
                if at > 0:
                    hi = at + len(mark)
                    break
        out.append((lo, hi))
        if hi >= len(text):
            break
        lo = max(hi - overlap, lo + 1)
    return out


def pre_segment(docs: DataFrame, size: int = 8000, overlap: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _chunks(docs, lambda t: pre_segment_spans(t, size, overlap), id_col, text_col)


def pack_sentences(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks of whole sentences of at most ``size`` characters; the next begins with whole sentences of the last ones."""
    import re

    ends = [m.end() for m in re.finditer(r"(?<=[.!?다요])\s+|\n\n+", text)]
    starts = [0, *ends]
    parts = [(a, b) for a, b in zip(starts, [*ends, len(text)], strict=True) if text[a:b].strip()]
    out, held = [], []
    for part in parts:
        if held and part[1] - held[0][0] > size:
            out.append((held[0][0], held[-1][1]))
            while held and held[-1][1] - held[0][0] > overlap:
                held.pop(0)
        held.append(part)
    if held:
        out.append((held[0][0], held[-1][1]))
    return out


def chunk_rag(docs: DataFrame, size: int = 500, overlap: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Retrieval chunks of whole sentences, with their true offsets."""
    return _chunks(docs, lambda t: pack_sentences(t, size, overlap), id_col, text_col)


def sentence_end_spans(text: str, size: int = 2000, overlap: int = 500) -> list[tuple[int, int]]:
    """Windows whose end moves back to the last sentence end if that lies in their second half."""
    out, lo = [], 0
    while lo < len(text):
        hi = min(len(text), lo + size)
        if hi < len(text):
            at = max(text.rfind(m, lo, hi) for m in (". ", "! ", "? ", ".\n"))
            if at - lo > size // 2:
                hi = at + 1
        out.append((lo, hi))
        if hi >= len(text):
            break
        lo = max(hi - overlap, lo + 1)
    return out


def chunk_oe(docs: DataFrame, size: int = 2000, overlap: int = 500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _chunks(docs, lambda t: sentence_end_spans(t, size, overlap), id_col, text_col)


def chunk_oe_rag(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Retrieval chunks inside every extraction chunk, numbered through the document."""
    outer = chunk_oe(docs, 2000, 500, id_col, text_col).withColumn("__k", F.struct(id_col, F.col("chunk_index"), "start_offset"))
    inner = chunk_rag(outer.select(F.to_json("__k").alias("__k"), "content"), 500, 100, "__k", "content")
    kind = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, chunk_index int, start_offset int"
    k = F.from_json("__k", kind)
    rows = inner.select(k[id_col].alias(id_col), k["chunk_index"].alias("source_oe_chunk_idx"), (k["start_offset"] + F.col("start_offset")).alias("start_offset"), "content", F.col("chunk_index").alias("__i"))
    place = Window.partitionBy(id_col).orderBy("source_oe_chunk_idx", "__i")
    return rows.select(id_col, (F.row_number().over(place) - 1).alias("chunk_index"), "source_oe_chunk_idx", "start_offset", "content")


def semantic_chunks(sentences: DataFrame, percent: float = 0.95, id_col: str = "doc_id") -> DataFrame:
    """(id, chunk, first, last, content): sentences (id, pos, sentence, vec) up to where the meaning turns.

    A chunk ends after a sentence whose cosine distance to the next is larger than the document's percentile.
    """
    order = Window.partitionBy("id").orderBy("pos")
    rows = sentences.select(F.col(id_col).alias("id"), "pos", "sentence", "vec").withColumn("gap", 1 - V.cosine(F.col("vec"), F.lead("vec").over(order)))
    bounds = rows.groupBy("id").agg(F.percentile("gap", F.lit(percent)).alias("bound"))
    broken = rows.join(bounds, "id").withColumn("turn", F.coalesce((F.lag("gap").over(order) > F.col("bound")).cast("int"), F.lit(0)))
    numbered = broken.withColumn("chunk", F.sum("turn").over(order))
    content = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentence"))), lambda s: s["sentence"]), " ")
    return numbered.groupBy("id", "chunk").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), content.alias("content"))


def pack_tokens(sizes: list[int], most: int, overlap: int) -> list[tuple[int, int]]:
    """(first, last + 1) of runs of sentences with at most ``most`` tokens; the next run begins with sentences of up to ``overlap``."""
    out, first, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > most:
            out.append((first, i))
            back, kept = i, 0
            while back - 1 > first and kept + sizes[back - 1] <= overlap and kept + sizes[back - 1] + n <= most:
                back -= 1
                kept += sizes[back]
            first, total = back, kept
        total += n
    return [*out, (first, len(sizes))] if sizes else out


def chunk_fixed_tokens(docs: DataFrame, most: int = 1024, overlap: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, start_offset, end_offset, content): whole sentences of at most so many words; a longer one is a chunk of its own."""

    def spans(text: str) -> list[tuple[int, int]]:
        found = [(m.start(), m.end()) for m in re.finditer(r"\S[^.!?。]*[.!?。]*", text)]
        return [(found[a][0], found[b - 1][1]) for a, b in pack_tokens([len(text[s:e].split()) for s, e in found], most, overlap)]

    return _chunks(docs, spans, id_col, text_col)


def sentence_end_near(text: str, target: int) -> int:
    """Where a context of about ``target`` characters ends: the sentence end nearest to it within 1.3 times, else the first one."""
    ends = [m.end() for m in re.finditer(r"[.!?。](?=\s|$)", text)]
    near = [e for e in ends if e <= 1.3 * target]
    return min(near, key=lambda e: (abs(e - target), e)) if near else ends[0] if ends else len(text)


def context_chunks(docs: DataFrame, target: int = 1_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, start_offset, end_offset, content): one after another, each ending at the sentence end that suits best."""

    def spans(text: str) -> list[tuple[int, int]]:
        out, at = [], 0
        while at < len(text):
            window = text[at : at + max(2 * target, 4_000)]
            end = at + sentence_end_near(window, target)
            out.append((at, end))
            more = re.compile(r"\S").search(text, end)
            at = more.start() if more else len(text)
        return out

    return _chunks(docs, spans, id_col, text_col)


def locate_chunks(chunks: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(id, chunk_index, start_offset, content), numbered by place: where each chunk (id, n, content) begins in its text.

    It is where the trimmed chunk occurs first, else its first words, else where the chunk before it ends.
    """
    bare = X.strip_blanks(F.col("content"))
    head = F.array_join(F.slice(F.split(bare, r"\s+"), 1, words), " ")
    whole, part = F.instr(F.col(text_col), bare), F.instr(F.col(text_col), head)
    rows = chunks.join(docs.select(F.col(id_col).alias("id"), text_col), "id")
    spot = F.when((whole > 0) & (bare != ""), whole - 1).when((part > 0) & (head != ""), part - 1)
    found = rows.select("id", "n", "content", spot.alias("at"))
    order = Window.partitionBy("id").orderBy("n")
    # lengths since the last chunk that was found
    group = F.count("at").over(order)
    found = found.withColumn("g", group).withColumn("own", F.length("content"))
    since = Window.partitionBy("id", "g").orderBy("n")
    before = F.coalesce(F.sum("own").over(since.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.coalesce(F.first("at").over(since), F.lit(0)) + before
    placed = found.withColumn("start_offset", F.coalesce("at", start))
    return placed.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("start_offset", "n")) - 1).alias("chunk_index"), "start_offset", "content")
