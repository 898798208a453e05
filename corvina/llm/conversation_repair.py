"""Cheapest repair of conversations whose turns are damaged: rank-convergence parallel Viterbi.

A repaired conversation has role initials ``(s?(ua)+)?``. Its rows are kept, given another role, deleted or completed by
inserted rows, at the least sum of costs; of equally cheap edits those whose initials are ASCII-least count. That is a
shortest path over four states (nothing yet, after s, after u, after a), and min-plus products of 4 x 4 steps.

Rows are range-partitioned by conversation and turn and numbered in that order, so a conversation of any length is spread
over tasks. A chunk has up to CHUNK successive rows of a conversation. Cost vectors run backward: the last chunk starts from
the true vector of an end, all others from a speculative one (zeros). The steps have such low rank that vectors soon
differ only by constants, whatever they started from. Fix-up passes then hand each chunk its follower's vector; a chunk reruns
only until its vector and the one before differ by a constant, because nothing changes ahead of there. Passes go on until no
chunk's vector changes. Ties and choices depend on differences only, so the stitched vectors drive a forward trace from each
state in which a chunk can be entered; which state that is follows from the chunks before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.llm.common import task_count
from corvina.session import saved

CHUNK_BITS = 12
NEXT = (2, 2, 3, 2)
INSERT, REROLE, DELETE, UNFINISHED = 3, 3, 4, 3
NOTHING = r"\A[\x20\x09-\x0D]*\z"
#: The last character that isn't blank ends a sentence.
FINISHED = r"[.!?][\x20\x09-\x0D]*\z"
SOUND, TRUNCATED, GONE = 0, 1, 2
CLASSES = "sua"

Vector = tuple[int, int, int, int]


def _insertions(w: list[int]) -> tuple[Vector, int]:
    """The vector w with rows inserted where that is cheaper, less its least entry; and that entry."""
    u, a = min(w[2], w[3] + INSERT), min(w[3], w[2] + INSERT)
    x = (min(w[0], u + INSERT), min(w[1], u + INSERT), u, a)
    least = min(x)
    return tuple(v - least for v in x), least  # type: ignore[return-value]


#: Before an end: nothing more, or what completes the last exchange.
END: Vector = _insertions([0, 99, 99, 0])[0]
SPECULATIVE: Vector = (0, 0, 0, 0)


def _edits(code: int, state: int, after: Vector) -> dict[str, tuple[int, int]]:
    """Cost and next state of each edit of a row that is legal in a state."""
    kind, fault = code % 4, code // 4
    out = {"D": (DELETE + after[state], state)}
    if fault != GONE:
        more = UNFINISHED if fault == TRUNCATED else 0
        to = {0: 1 if state == 0 else None, 1: 2 if state != 2 else None, 2: 3 if state == 2 else None}.get(kind)
        if to is not None:
            out["K"] = (more + after[to], to)
        out["R"] = (REROLE + more + after[NEXT[state]], NEXT[state])
    return out


@cache
def back(code: int, after: Vector) -> tuple[Vector, int]:
    """The vector before a row from the one after it, less its least entry; and that entry."""
    return _insertions([min(c for c, _ in _edits(code, q, after).values()) for q in range(4)])


@cache
def step(code: int, state: int, after: Vector) -> tuple[str, str, int, int]:
    """The ASCII-least cheapest edits up to and with a row: initials, roles of what stays, next state, cost."""
    w = [min(c for c, _ in _edits(code, q, after).values()) for q in range(4)]
    x, least = _insertions(w)
    edits, roles, cost = "", "", 0
    while True:
        ways = _edits(code, state, after)
        best = x[state] + least
        if ways["D"][0] == best:
            return edits + "D", roles, state, cost + DELETE
        if x[NEXT[state]] + least + INSERT == best:
            state, edits, cost = NEXT[state], edits + "I", cost + INSERT
            roles += CLASSES[state - 1]
            continue
        letter = "K" if "K" in ways and ways["K"][0] == best else "R"
        to = ways[letter][1]
        return edits + letter, roles + CLASSES[to - 1], to, cost + ways[letter][0] - after[to]


def closing(state: int) -> tuple[str, str, int]:
    """Rows inserted at the end: initials, roles, cost."""
    return {0: ("", "", 0), 1: ("II", "ua", 2 * INSERT), 2: ("I", "a", INSERT), 3: ("", "", 0)}[state]


def _codes(text: str) -> bytes:
    """A chunk's codes, the first row first; they are letters from A on."""
    return bytes(c - 65 for c in text.encode())


def run_back(codes: bytes, end: Vector, known: Vector | None = None, start: Vector | None = None) -> Vector:
    """The vector before the first row; ``known`` led to ``start``, so where both differ by a constant the run ends."""
    now = end
    for code in reversed(codes):
        if known is not None:
            if now == known:
                return start  # type: ignore[return-value]
            known = back(code, known)[0]
        now = back(code, now)[0]
    return now


#: What goes through the passes with each chunk's vectors.
KEPT = ["chunk", "codes", "is_first", "is_last"]


def _vectors(b: pa.RecordBatch, ends: list, starts: list) -> pa.RecordBatch:
    kind = pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays([*(b.column(c) for c in KEPT), pa.array(ends, kind), pa.array(starts, kind)], names=[*KEPT, "end", "start"])


def _speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ends = [END if x else SPECULATIVE for x in b.column("is_last").to_pylist()]
        yield _vectors(b, ends, [run_back(_codes(c), e) for c, e in zip(b.column("codes").to_pylist(), ends, strict=True)])


def _fix_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ends, starts = [], []
        for c, told, used, start in zip(*(b.column(x).to_pylist() for x in ("codes", "told", "end", "start")), strict=True):
            new, old, start = tuple(told or used), tuple(used), tuple(start)
            ends.append(new)
            starts.append(start if new == old else run_back(_codes(c), new, old, start))
        yield _vectors(b, ends, starts)


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each state of entry the edits of a chunk's rows, the roles of what stays, the state at the end and the cost."""
    for b in batches:
        out: list[list] = []
        for c, end, first, last in zip(*(b.column(x).to_pylist() for x in ("codes", "end", "is_first", "is_last")), strict=True):
            codes, after = _codes(c), [tuple(end)]
            for code in reversed(codes[1:]):
                after.append(back(code, after[-1])[0])
            ways = []
            for state in (0,) if first else range(4):
                edits, roles, cost = [], [], 0
                for code, v in zip(codes, reversed(after), strict=True):
                    e, r, state, spent = step(code, state, v)
                    edits.append(e)
                    roles.append(r)
                    cost += spent
                if last:
                    e, r, spent = closing(state)
                    edits[-1], roles[-1], cost = edits[-1] + e, roles[-1] + r, cost + spent
                ways.append({"edits": edits, "roles": roles, "state": state, "cost": cost})
            out.append(ways)
        kind = pa.list_(pa.struct([("edits", pa.list_(pa.string())), ("roles", pa.list_(pa.string())), ("state", pa.int32()), ("cost", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column("chunk"), b.column("is_first"), pa.array(out, kind)], names=["chunk", "is_first", "ways"])


def _enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each chunk is entered, from the states in which those before it end; chunks come in order."""
    state = 0
    for b in batches:
        entries = []
        for first, ends in zip(b.column("is_first").to_pylist(), b.column("states").to_pylist(), strict=True):
            state = 0 if first else state
            entries.append(state)
            state = ends[state]
        yield pa.RecordBatch.from_arrays([b.column("chunk"), pa.array(entries, pa.int32())], names=["chunk", "entry"])


def placed_rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, place): rows in order of conversation, turn (nulls first), role and the text's MD5, numbered."""
    told = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    size = told.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    # equal rows are told apart, so that a range can end among them
    told = told.withColumn("__h", F.md5("text")).withColumn("__n", F.monotonically_increasing_id())
    key = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "__h", "__n"]
    ranged = told.repartitionByRange(task_count(rows.sparkSession, size), *key).sortWithinPartitions(*key)
    return saved(ranged.select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("place")), "rows")


def _coded(placed: DataFrame) -> DataFrame:
    """(conv, turn, place, blank, duplicate, truncated, kind): a row's first fault, and its role: 0 s, 1 u, 2 a, 3 other."""
    initial = F.substring("role", 1, 1)
    slim = placed.select(
        "conv", "turn", "place", F.col("text").rlike(NOTHING).alias("blank"), F.col("text").rlike(FINISHED).alias("done"), F.md5(F.concat("role", F.lit("\u0000"), "text")).alias("h"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("kind"),
    )
    first = slim.where("not blank").groupBy("conv", "h").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("is_first"))
    seen = ~F.col("blank") & F.col("is_first").isNull()
    rows = slim.join(first, "place", "left").withColumn("duplicate", seen)
    return rows.select("conv", "turn", "place", "blank", "duplicate", (~F.col("blank") & ~F.col("duplicate") & ~F.col("done")).alias("truncated"), "kind")


def _chunks(coded: DataFrame) -> DataFrame:
    """(conv, chunk, codes, places, illegal, head, tail): up to 2 ** CHUNK_BITS successive rows each; chunk is the first place."""
    code = F.col("kind") + 4 * F.when(F.col("blank") | F.col("duplicate"), GONE).when(F.col("truncated"), TRUNCATED).otherwise(SOUND)
    rows = coded.select("conv", "place", F.shiftright("place", CHUNK_BITS).alias("b"), F.char(65 + code).alias("code"))
    rows = rows.groupBy("conv", "b").agg(F.array_sort(F.collect_list(F.struct("place", "code"))).alias("r"))
    roles = F.translate("codes", "ABCDEFGHIJKL", (CLASSES + "x") * 3)
    legal = sum((F.regexp_count("roles", F.lit(x)) for x in ("su", "ua", "au")), F.lit(0))
    chunks = rows.select("conv", F.col("r.place").alias("places"), F.array_join("r.code", "").alias("codes")).withColumn("roles", roles)
    return chunks.select(
        "conv", F.col("places")[0].alias("chunk"), "codes", "places", (F.length("codes") - 1 - legal).alias("illegal"), F.substring("roles", 1, 1).alias("head"), F.substring("roles", -1, 1).alias("tail")
    )


def stitched(chunks: DataFrame) -> DataFrame:
    """Chunks (conv, chunk, codes) with is_first, is_last, and cost vectors ``end`` and ``start``, true but for a constant each."""
    slim = chunks.select("conv", "chunk")
    ends = slim.groupBy("conv").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last"))
    marks = ends.select(F.inline(F.array(F.struct(F.col("first").alias("chunk"), F.lit(1).alias("f"), F.lit(0).alias("l")), F.struct(F.col("last").alias("chunk"), F.lit(0).alias("f"), F.lit(1).alias("l")))))
    marks = marks.groupBy("chunk").agg(F.max("f").alias("f"), F.max("l").alias("l"))  # chunks have names of their own, so no key is hot
    marked = chunks.join(marks, "chunk", "left").select("chunk", "codes", (F.coalesce("f", F.lit(0)) == 1).alias("is_first"), (F.coalesce("l", F.lit(0)) == 1).alias("is_last"))
    vectors = "chunk long, codes string, is_first boolean, is_last boolean, end array<int>, start array<int>"
    now = saved(marked.mapInArrow(_speculate, vectors), "vectors")
    # a chunk's follower in its conversation: one row for each chunk, and only where there are several
    follows = slim.withColumn("next", F.lead("chunk").over(Window.partitionBy("conv").orderBy("chunk"))).where("next is not null")
    follows = saved(follows.select("chunk", "next"), "follows")
    while True:
        starts = now.select(F.col("chunk").alias("next"), F.col("start").alias("told"))
        told = now.select("chunk", "end").join(follows, "chunk").join(starts, "next").where("told <> end").select("chunk", "told")
        told = saved(told, "told")
        if told.isEmpty():
            return now
        now = saved(now.join(told, "chunk", "left").mapInArrow(_fix_up, vectors), "vectors")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", originals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Conversations and their repaired rows.

    The first table has one row for each conversation of ``originals`` (by default of rows): conv, gaps (turns missing
    between the least and the greatest), blank, duplicate, truncated (rows by their first fault), illegal (successive role
    initials other than su, ua, au), cost, and audit, the initials of the edits in order: Keep, Rerole, Delete, Insert. The
    second has the rows that stay, conv, place, nth (more than one where rows are inserted before), role and text, in
    the order of place and nth.

    A row is blank without a character other than blanks, else duplicate if its role and text came before in the
    conversation, else truncated if its last such character is none of ``. ! ?``. Blank and duplicate rows must be deleted
    (4), others may be kept (0), get the role user or assistant (3) or be deleted; rows with one of these roles and no
    text may be inserted anywhere (3); a truncated row that stays costs 3 more.

    A null role or text counts as one space; null turns come first, and null conversations are one. Rows with equal turns are
    ordered by role and by the text's MD5. A conversation without rows gets zeros and an empty audit. An empty table gives
    empty results. Other columns aren't read.
    """
    placed = placed_rows(rows, conv, turn, role, text)
    coded = saved(_coded(placed), "codes")
    chunks = saved(_chunks(coded), "chunks")
    way = "array<struct<edits: array<string>, roles: array<string>, state: int, cost: bigint>>"
    ways = saved(stitched(chunks).mapInArrow(_trace, f"chunk long, is_first boolean, ways {way}"), "ways")
    # chunks of a conversation in order, with nothing but the states in which they end
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    states = ways.join(chunks.select("conv", "chunk"), "chunk").select("conv", "chunk", "is_first", F.col("ways.state").alias("states"))
    entries = states.repartition(parts, "conv").sortWithinPartitions("conv", "chunk").select("chunk", "is_first", "states").mapInArrow(_enter, "chunk long, entry int")
    chosen = ways.join(entries, "chunk").select("chunk", F.col("ways")[F.col("entry")].alias("way"))
    chosen = saved(chosen.join(chunks.select("conv", "chunk", "places"), "chunk").select("conv", "chunk", "places", "way.edits", "way.roles", "way.cost"), "edits")

    turns = coded.groupBy("conv", "turn").agg(*[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    faults = turns.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    before = F.lag("tail").over(Window.partitionBy("conv").orderBy("chunk"))  # one row for each chunk
    joined = chunks.select("conv", "chunk", "illegal", "head", "tail").withColumn("pair", F.concat(before, "head"))
    broken = joined.select("conv", (F.col("illegal") + F.when(F.col("pair").isNull() | F.col("pair").isin("su", "ua", "au"), 0).otherwise(1)).alias("illegal"))
    audits = chosen.select("conv", "cost", F.struct("chunk", F.array_join("edits", "").alias("audit")).alias("piece"))
    every = (rows if originals is None else originals).select(F.col(conv).alias("conv")).distinct()
    told = every.unionByName(faults, allowMissingColumns=True).unionByName(broken, allowMissingColumns=True).unionByName(audits, allowMissingColumns=True)
    counts = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    audit = F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda x: x["audit"]), "").alias("audit")
    summary = told.groupBy("conv").agg(*counts, audit)

    edits = chosen.select("conv", F.explode(F.arrays_zip("places", "edits", "roles")).alias("e")).select("conv", F.col("e.places").alias("place"), "e.edits", "e.roles").where("roles <> ''")
    letters = F.filter(F.split("edits", ""), lambda x: ~x.isin("D", ""))
    lines = F.zip_with(letters, F.filter(F.split("roles", ""), lambda x: x != ""), lambda e, r: F.struct(e.alias("edit"), r.alias("to")))
    stay = edits.join(placed.select("place", "role", "text"), "place").select("conv", "place", "role", "text", F.posexplode(lines).alias("nth", "line"))
    named = F.when(F.col("line.edit") == "K", F.col("role")).when(F.col("line.to") == "u", "user").otherwise("assistant")
    return summary, stay.select("conv", "place", "nth", named.alias("role"), F.when(F.col("line.edit") == "I", "").otherwise(F.col("text")).alias("text"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, which come in order; nothing but the hash so far is held."""
    now, sha, any_yet = None, None, False
    for b in batches:
        done: list[tuple] = []
        for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
            if any_yet and conv == now:
                sha.update(b"\n")
            else:
                if any_yet:
                    done.append((now, sha.hexdigest()))
                now, sha, any_yet = conv, hashlib.sha256(), True
            sha.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], b.schema.field("conv").type), pa.array([x[1] for x in done], pa.string())], names=["conv", "repaired_sha256"])
    if any_yet:
        yield pa.RecordBatch.from_arrays([pa.array([now], b.schema.field("conv").type), pa.array([sha.hexdigest()], pa.string())], names=["conv", "repaired_sha256"])


def with_digests(summary: DataFrame, repaired: DataFrame) -> DataFrame:
    """``summary`` with repaired_sha256, of the repaired rows as lines ``role:text``. A hash is sequential, so it takes a conversation's rows in turn."""
    parts = max(1, int(summary.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = repaired.schema["conv"].dataType.simpleString()
    lines = repaired.repartition(parts, "conv").sortWithinPartitions("conv", "place", "nth").select("conv", "role", "text")
    digests = lines.mapInArrow(_digest, f"conv {kind}, repaired_sha256 string").withColumnRenamed("conv", "__conv")
    told = summary.join(digests, F.col("conv").eqNullSafe(F.col("__conv")), "left").drop("__conv")
    return told.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``rows`` with faults by the CRC-32 of ``conv:turn`` modulo 20: 0 drops a row, 1 empties it, 2 takes its ``. ! ?``, 3 repeats it, 4 makes it the user's.

    Nulls count as one space: in the key, and as role and text.
    """
    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    hit = F.crc32(F.concat(known(conv), F.lit(":"), known(turn))) % 20
    told = rows.select(conv, turn, known(role).alias(role), known(text).alias(text), hit.alias("__hit")).where("__hit <> 0")
    told = told.withColumn(text, F.when(F.col("__hit") == 1, "").when(F.col("__hit") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(F.col(text)))
    told = told.withColumn(role, F.when(F.col("__hit") == 4, "user").otherwise(F.col(role)))
    return told.withColumn("__copy", F.explode(F.when(F.col("__hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(conv, turn, role, text)
