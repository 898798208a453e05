"""Language-model scores of whole documents.

Word counts come from all training documents. The commonest words (a bounded number, none very long) are tokens of the
recurrent model. All other words share tail tokens by their last two bytes: the commonest endings have a token each, the
rest one together; within its token a word has the share of its count plus one. So the model gives each sequence of words a
probability, the counts of all words enter its score, and what it has read so far tells it which endings to expect.

Documents are tokenised once more after the counts, into a table of token numbers that training and scoring read. The
recurrent model learns from every training document once, by truncated backpropagation in three rounds of growing size. In
a round documents are dealt by a hash to workers of about WORKER tokens each, so workers grow in number with the input and
don't depend on files or settings; a worker runs through its documents, ordered by hash, with the weights that the round
began with, and the workers' weights are averaged, each by its tokens. The averages are made in Spark, piece by piece.
Scoring is one pass over all documents that carries the state through each whole text; words outside a bounded list of
counts are kept for a join with all counts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import task_count
from corvina.llm.gru import Gru
from corvina.session import saved

#: The model's words, the words whose counts every task knows, and the longest of these in bytes.
VOCABULARY, KNOWN, LONGEST = 4_096, 65_536, 2_048
#: Endings with a token of their own, and their bytes.
TAILS, ENDING = 128, 2
#: Up to which share of the training documents each round goes, and its rate.
ROUNDS = ((1 / 16, 1.2e-2), (1 / 4, 8e-3), (1.0, 4e-3))
#: Tokens of a worker, of a run of training, and scored together, and weights of a piece that is averaged.
WORKER, RUN, TOGETHER, PIECE = 2_000_000, 196_608, 1_000_000, 4_096
_LN10 = math.log(10)


def words_of(text: bytes | None) -> list[bytes]:
    """The words; A-Z are lower-cased, and the six ASCII blanks part words."""
    return (text or b"").lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def told() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
        counts.clear()
        return out

    for b in batches:
        for text in b.column(0):
            counts.update(words_of(text.as_py()))
            if len(counts) > 300_000:
                yield told()
    yield told()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) over all rows; counts are summed in each task before they are shuffled."""
    return docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Numbers for the commonest words, the end and the tails, by falling count.

    head: (word, count); tails: (ending, count, mass), the last of them with ending None for all other endings. A word of a
    tail has the share (count + 1) / mass of its token; the mass holds one for words never seen.
    """

    def __init__(self, head: list[tuple[bytes, int]], ends: int, tails: list[tuple[bytes | None, int, int]]):
        rows = sorted([(-c, 0, w) for w, c in head] + [(-ends, 1, b"")] + [(-c, 2, n) for n, (_, c, _) in enumerate(tails)], key=lambda r: (r[0], r[1], r[2] if r[1] < 2 else b"", r[2] if r[1] == 2 else 0))
        self.counts = np.array([-r[0] for r in rows], dtype=np.float64)
        self.number = {r[2]: i for i, r in enumerate(rows) if r[1] == 0}
        self.end = next(i for i, r in enumerate(rows) if r[1] == 1)
        place = {r[2]: i for i, r in enumerate(rows) if r[1] == 2}
        self.ending = {e: place[n] for n, (e, _, _) in enumerate(tails) if e is not None}
        self.other = place[len(tails) - 1]
        self.mass = np.ones(len(rows))
        for n, (_, _, mass) in enumerate(tails):
            self.mass[place[n]] = mass

    def tail(self, word: bytes) -> int:
        return self.ending.get(word[-ENDING:], self.other)

    def encode(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.array([*[self.tail(w) if (k := get(w)) is None else k for w in words], self.end], dtype=np.int32)


def _tails(counts: DataFrame, head: list[tuple[bytes, int]]) -> list[tuple[bytes | None, int, int]]:
    """(ending, count, mass) of the words outside head, the commonest endings first, and all others together."""
    found = counts.groupBy(F.substring("word", -ENDING, ENDING).alias("e")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()  # one or two bytes: 65,792 at most
    sums = {bytes(r.e): [r.c, r.n] for r in found}
    for w, c in head:
        own = sums[w[-ENDING:]]
        own[0] -= c
        own[1] -= 1
    ordered = sorted(((c, n, e) for e, (c, n) in sums.items() if n), key=lambda r: (-r[0], r[2]))
    rest = ordered[TAILS:]
    return [*((e, c, c + n + 1) for c, n, e in ordered[:TAILS]), (None, sum(r[0] for r in rest), sum(r[0] + r[1] for r in rest) + 1)]


_KINDS = pa.schema([("piece", pa.int32()), ("n", pa.int64()), ("weights", pa.binary())])


def _train(counts: np.ndarray, end: int, weights: np.ndarray, rate: float):
    def told(model: Gru, n: int) -> pa.RecordBatch:
        parts = np.split(model.flat().astype("<f4"), range(PIECE, len(weights), PIECE))
        return pa.RecordBatch.from_pydict({"piece": range(len(parts)), "n": [n] * len(parts), "weights": [x.tobytes() for x in parts]}, schema=_KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, worker, held, waiting, n = None, None, [], 0, 0
        for b in batches:
            for w, ids in zip(b.column("worker").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if w != worker:
                    if held:
                        model.train(np.concatenate(held), end, rate=rate)
                    if n + waiting:
                        yield told(model, n + waiting)
                    model, worker, held, waiting, n = Gru(counts), w, [], 0, 0
                    model.set_flat(weights)
                held.append(np.frombuffer(ids, "<u2").astype(np.int32))
                waiting += len(held[-1])
                if waiting >= RUN:
                    model.train(np.concatenate(held), end, rate=rate)
                    held, waiting, n = [], 0, n + waiting
        if held:
            model.train(np.concatenate(held), end, rate=rate)
        if n + waiting:
            yield told(model, n + waiting)

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The averages of the pieces, which come sorted."""
    at, total, sums = None, 0, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([(sums / total).astype("<f4").tobytes()], pa.binary())], names=["piece", "weights"])

    for b in batches:
        for piece, n, weights in zip(*(b.column(c).to_pylist() for c in ("piece", "n", "weights")), strict=True):
            if piece != at:
                if at is not None:
                    yield told()
                at, total, sums = piece, 0, 0.0
            sums = sums + n * np.frombuffer(weights, "<f4").astype(np.float64)
            total += n
    if at is not None:
        yield told()


def train(encoded: DataFrame, vocab: Vocabulary) -> Gru:
    """A model that has learnt from all training rows of ``encoded``; only its own weights come to the driver."""
    model = Gru(vocab.counts)
    n = min(task_count(encoded.sparkSession, 0), -(-len(model.flat()) // PIECE))
    ends = [upto for upto, _ in ROUNDS]
    share = F.pmod("h", F.lit(1 << 20)) / float(1 << 20)
    place = F.lit(len(ends) - 1)
    for k in range(len(ends) - 2, -1, -1):
        place = F.when(share < ends[k], k).otherwise(place)
    rows = encoded.where("trains").withColumn("round", place)
    sizes = dict(rows.groupBy("round").agg(F.sum("n_tokens")).collect())
    for k, (_, rate) in enumerate(ROUNDS):
        workers = -(-sizes.get(k, 0) // WORKER)
        if not workers:
            continue
        dealt = rows.where(F.col("round") == k).select(F.pmod(F.xxhash64("h", F.lit(7)), F.lit(workers)).alias("worker"), "h", "ids")
        dealt = dealt.repartition(workers, "worker").sortWithinPartitions("worker", "h", "ids").select("worker", "ids")
        told = dealt.mapInArrow(_train(vocab.counts, vocab.end, model.flat(), rate), "piece int, n long, weights binary")
        ordered = told.repartition(n, "piece").sortWithinPartitions("piece", "n", F.xxhash64("weights"))
        got = ordered.mapInArrow(_average, "piece int, weights binary").collect()  # as many rows as the model has pieces
        model.set_flat(np.concatenate([np.frombuffer(r.weights, "<f4") for r in sorted(got, key=lambda r: r.piece)]))
    return model


def _commonest(counts: DataFrame, most: int) -> list:
    """The commonest words, at most ``most``: by falling count, of equal counts those with the smallest hashes.

    Levels of counts, and within the level that doesn't fit slots of hashes, tell which rows to collect; no sort is needed.
    """
    level = F.floor(F.log(F.col("c")) * 64)  # a few thousand levels at most
    levels = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, n = None, 0
    for at, size in levels:
        if n + size > most:
            slot = F.shiftrightunsigned(F.xxhash64("word"), 52)  # 4,096 slots
            in_level = counts.where(level == at)
            slots = dict(in_level.groupBy(F.col("c"), slot.alias("slot")).count().groupBy("c").agg(F.map_from_entries(F.collect_list(F.struct("slot", "count")))).collect())
            chosen = []
            for c in sorted(slots, reverse=True):  # counts of one level
                for k in sorted(slots[c]):
                    if n + slots[c][k] > most:
                        break
                    n += slots[c][k]
                    chosen.append((c, k))
                else:
                    continue
                break
            rows = counts.where(level > at).collect()
            if chosen:
                c, k = chosen[-1]
                rows += in_level.where((F.col("c") > c) | ((F.col("c") == c) & (slot <= k))).collect()
            return sorted(rows, key=lambda r: (-r[1], bytes(r[0])))
        least, n = at, n + size
    rows = counts.where(level >= least).collect() if least is not None else []
    return sorted(rows, key=lambda r: (-r[1], bytes(r[0])))


class LanguageModel:
    """What is learnt: the counts of all words (a table), their sums, the vocabulary, the further known counts, the weights.

    ``encoded`` are the documents as token numbers, ``trains`` tells those that were learnt from.
    """

    def __init__(self, docs: DataFrame, training: Column | None = None, id_col: str = "doc_id", text_col: str = "text"):
        training = F.lit(True) if training is None else training
        taught = docs.where(training)
        self.counts = saved(word_counts(taught, text_col), "counts")
        ends = taught.count()
        words, distinct = self.counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        self.total, self.types = words + ends, distinct + (ends > 0)
        common = _commonest(self.counts.where(F.length("word") <= LONGEST), KNOWN)
        head = [(bytes(r[0]), r[1]) for r in common[:VOCABULARY]]
        self.known = {bytes(r[0]): r[1] for r in common[VOCABULARY:]}
        self.vocab = Vocabulary(head, ends, _tails(self.counts, head))
        self.encoded = self.encode(docs, training, id_col, text_col)
        self.model = train(self.encoded, self.vocab)

    def encode(self, docs: DataFrame, training: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        h = F.xxhash64(F.lit(23), F.col(id_col), F.col(text_col))
        trains = F.coalesce(F.lit(False) if training is None else training, F.lit(False))
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), trains.alias("trains"), h.alias("h"))
        return saved(rows.mapInArrow(_encode(self.vocab, self.known), _ENCODED), "encoded")


_ENCODED = (
    "uid long, id long, trains boolean, h long, n_tokens long, n_known long, known_log double, tail_log double, tail_norm double, tail array<binary>, times array<long>, ids binary"
)
_ENCODED_ARROW = pa.schema([
    ("uid", pa.int64()), ("id", pa.int64()), ("trains", pa.bool_()), ("h", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("known_log", pa.float64()),
    ("tail_log", pa.float64()), ("tail_norm", pa.float64()), ("tail", pa.list_(pa.binary())), ("times", pa.list_(pa.int64())), ("ids", pa.binary()),
])


def _encode(vocab: Vocabulary, known: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # one number for each word whose count is known here: the model's tokens, then the further words
        size = len(vocab.counts)
        number = vocab.number | {w: size + i for i, w in enumerate(known)}
        get, logs = number.get, np.log10(np.concatenate([vocab.counts, np.fromiter(known.values(), float, len(known)), [0.0]]) + 1)
        rare, end_known = len(logs) - 1, int(vocab.counts[vocab.end] > 0)
        token = np.array([*range(size), *[vocab.tail(w) for w in known], 0], dtype=np.int32)
        norms, ending, other = np.log10(vocab.mass), vocab.ending.get, vocab.other  # norms are zero for tokens that are words
        uid, rows, waiting = TaskContext.get().partitionId() << 40, [], 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ENCODED_ARROW, strict=True)], schema=_ENCODED_ARROW)

        for b in batches:
            for doc, trains, h, text in zip(*(b.column(c).to_pylist() for c in ("id", "trains", "h")), b.column("text"), strict=True):
                words = words_of(text.as_py())
                k = np.array([*[get(w, rare) for w in words], vocab.end], dtype=np.int32)
                ids, in_head = token[k], k < size
                unknown = np.flatnonzero(k == rare).tolist()
                others = [words[i] for i in unknown]
                ids[unknown] = [ending(w[-ENDING:], other) for w in others]
                tail = Counter(others)
                log = logs[k]
                n_known = len(k) - len(unknown) - 1 + end_known
                rows.append((uid, doc, trains, h, len(k), n_known, float(log[in_head].sum()), float(log[~in_head].sum()), float(norms[ids].sum()), list(tail), list(tail.values()), ids.astype("<u2").tobytes()))
                uid, waiting = uid + 1, waiting + len(k)
                if waiting >= TOGETHER:
                    yield told()
                    rows, waiting = [], 0
        if rows:
            yield told()

    return run


def _score(model: Gru, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids, held, waiting = [], [], 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(model.score(held, end))], names=["uid", "model_log"])

        for b in batches:
            for uid, ids in zip(b.column("uid").to_pylist(), b.column("ids").to_pylist(), strict=True):
                uids.append(uid)
                held.append(np.frombuffer(ids, "<u2").astype(np.int32))
                waiting += len(held[-1])
                if waiting >= TOGETHER:
                    yield told()
                    uids, held, waiting = [], [], 0
        if uids:
            yield told()

    return run


def _scored(lm: LanguageModel, encoded: DataFrame) -> DataFrame:
    likely = encoded.select("uid", "ids").mapInArrow(_score(lm.model, lm.vocab.end), "uid long, model_log double")
    tail = encoded.select("uid", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("uid", F.col("t.tail").alias("word"), F.col("t.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    tails = tail.join(lm.counts, "word", "left").groupBy("uid").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare"), F.sum(F.col("times") * F.log10(c + 1)).alias("rare_log")
    )
    whole = encoded.drop("tail", "times", "ids").join(likely, "uid").join(tails, "uid", "left")
    tail_log = F.col("tail_log") + F.coalesce("rare_log", F.lit(0.0))
    return whole.select(
        "id", "n_tokens", (F.col("n_known") + F.coalesce("rare", F.lit(0))).alias("n_known"), F.lit(lm.total).cast("long").alias("train_tokens"),
        (F.col("known_log") + tail_log - F.col("n_tokens") * math.log10(lm.total + lm.types + 1)).alias("base_score"),
        (F.col("model_log") / _LN10 + tail_log - F.col("tail_norm")).alias("score"),
    )


def score_with(lm: LanguageModel, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, n_known, train_tokens, base_score, score), one for each row of docs; see ``score_documents``."""
    return _scored(lm, lm.encode(docs, None, id_col, text_col))


def score_documents(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, n_known, train_tokens, base_score, score), one for each row of docs; log10 probabilities.

    ``training`` is a condition on docs; the rows for which it holds are learnt from. Null and empty texts are the end
    token alone. Repeated rows are scored each, and count as often in training; a null id is an id like others. With no
    training row every token is unknown. An empty table gives an empty result. Scores depend on the rows, not on how they
    are partitioned or on settings. Only the named columns and those of the condition are read.
    """
    lm = LanguageModel(docs, training, id_col, text_col)
    return _scored(lm, lm.encoded)
