"""Document status from events: a batch form, and the same as a stateful stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvina.functions import text as X
from corvina.operators.bm25 import Index
from corvina.operators.chunking import chunk_by_size


def latest_status(events: DataFrame) -> DataFrame:
    """(doc_id, status, ts) of the latest event of each document; of equal times, the larger event id."""
    last = F.max(F.struct("ts", "event_id", "status"))
    return events.groupBy("doc_id").agg(last.alias("l")).select("doc_id", "l.status", "l.ts")


def stale_documents(events: DataFrame, now, processing_minutes: int = 10, deleting_minutes: int = 5) -> DataFrame:
    """Documents whose latest status is older than it may be; ``now`` is a timestamp column or literal."""
    age = F.unix_timestamp(F.lit(now) if not hasattr(now, "cast") else now) - F.unix_timestamp("ts")
    late = ((F.col("status") == "processing") & (age > 60 * processing_minutes)) | ((F.col("status") == "deleting") & (age > 60 * deleting_minutes))
    return latest_status(events).where(late)


def latest_status_stream(events: DataFrame) -> DataFrame:
    """The stream form, for update mode: one row of state for each document; every batch tells the documents that it touched."""
    latest = events.groupBy("doc_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("e"))
    return latest.select("doc_id", "e.status", "e.ts")


# Minutes that a document may stay in a state.
LIMITS = {"processing": 10, "deleting": 5}


def stale_spells(events: DataFrame, now, limits: dict[str, int] = LIMITS) -> DataFrame:
    """(doc_id, status, ts) of every event after which a document stayed in a state of ``limits`` for longer than it may.

    What ends a stay is the document's next event or ``now``; events after ``now`` don't count. The batch twin of
    ``stale_stream``, and unlike ``stale_documents`` it tells stays that have ended since, too.
    """
    now = now if hasattr(now, "cast") else F.lit(now)
    seen = events.where(F.col("ts") <= now)
    after = F.lead("ts").over(Window.partitionBy("doc_id").orderBy("ts", "event_id"))
    most = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    spent = F.unix_micros(F.coalesce(after, now).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return seen.withColumn("spent", spent).where(F.col("spent") > most[F.col("status")] * 60_000_000).select("doc_id", "status", "ts")


def stale_stream(events: DataFrame, delay: str = "5 minutes", limits: dict[str, int] = LIMITS) -> DataFrame:
    """The stream form, for append mode: a document is told as stale by a timer, without a new event of its own.

    Each document's state is its last event and those that the watermark (``delay`` behind the latest time seen of any
    document) hasn't reached. Events count in the order of their times once the watermark has passed them, so the result
    doesn't depend on how they are cut into batches; later ones are dropped. A timer is set where a stay gets too long; a
    document that needs none keeps no state.
    """
    kinds = {c: events.schema[c].dataType for c in ("doc_id", "event_id", "status", "ts")}
    most = {k: v * 60_000_000 for k, v in limits.items()}

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = [tuple(x) for x in json.loads(state.get[0])] if state.exists else []
        last = tuple(json.loads(state.get[1])) if state.exists and state.get[1] else None
        if not state.hasTimedOut:
            for f in frames:
                waiting += zip(f["us"].tolist(), f["event_id"].tolist(), f["status"].tolist(), strict=True)
        mark, told = state.getCurrentWatermarkMs() * 1000, []
        waiting.sort()
        while waiting and waiting[0][0] <= mark:
            now = waiting.pop(0)
            if last and last[2] in most and now[0] - last[0] > most[last[2]]:
                told.append(last)
            last = now
        if last and (last[2] not in most or mark - last[0] > most[last[2]]):
            if last[2] in most:
                told.append(last)
            last = None
        ahead = [x for x in (waiting[0][0] if waiting else None, last[0] + most[last[2]] if last else None) if x is not None]
        if ahead:
            state.update((json.dumps(waiting), json.dumps(last) if last else None))
            state.setTimeoutTimestamp(max(min(ahead), mark) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"doc_id": [key[0]] * len(told), "status": [x[2] for x in told], "us": [x[0] for x in told]})

    names = {c: k.simpleString() for c, k in kinds.items()}
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).select("doc_id", "event_id", "status", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", delay)
    out = rows.groupBy("doc_id").applyInPandasWithState(update, f"doc_id {names['doc_id']}, status string, us long", "waiting string, last string", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("doc_id", "status", F.timestamp_micros("us").cast(kinds["ts"]).alias("ts"))


#: Chunks whose tokens a task counts.
CHUNKS_AT_ONCE = 20_000


def ingest_stream(source: DataFrame, target: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1_000, overlap: int = 200, event_time: str | None = None, keep: str = "7 days"):
    """Documents of a stream, cleaned and cut to chunks, each once: chunks and their index entries go to ``target``.

    The first row of an id counts. Ids are remembered in the stream's state, for good or, with ``event_time``, for as long as
    ``keep`` says; the target is never read. A batch writes its own folders in place of what an earlier try has left there,
    so a batch that is repeated after a failure changes nothing. Below ``target``: chunks, postings (id, dl, term, tf) and
    lengths (id, dl), each by batch; ``read_ingested`` and ``ingested_index`` read them.
    """
    once = source.withWatermark(event_time, keep).dropDuplicatesWithinWatermark([id_col]) if event_time else source.dropDuplicates([id_col])

    def write(batch: DataFrame, number: int) -> None:
        clean = batch.select(id_col, X.clean_text(F.col(text_col)).alias(text_col))
        chunks = chunk_by_size(clean, size, overlap, id_col, text_col)
        chunks = chunks.withColumn("chunk_id", F.concat_ws("_", F.col(id_col).cast("string"), F.col("chunk_index").cast("string")))
        place = f"{target}/chunks/batch={number}"
        chunks.write.mode("overwrite").parquet(place)
        written = batch.sparkSession.read.schema(chunks.schema).parquet(place).select(F.col("chunk_id").alias("id"), "content")

        def words(rows: DataFrame) -> DataFrame:
            return rows.select("id", X.tokens(F.col("content")).alias("t")).select("id", "t", F.size("t").cast("long").alias("dl"))

        words(written).select("id", "dl").write.mode("overwrite").parquet(f"{target}/lengths/batch={number}")
        # dealt by id before they fall into tokens, so that postings need no further shuffle; as many parts as keep a task's tokens few
        parts = max(int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-written.count() // CHUNKS_AT_ONCE))
        terms = words(written.repartition(parts, "id")).select("id", "dl", F.explode("t").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
        terms.write.mode("overwrite").parquet(f"{target}/postings/batch={number}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/chunks").drop("batch")


def ingested_index(spark: SparkSession, target: str) -> Index:
    """The index over all batches so far; document frequencies are counted over them."""
    postings = spark.read.parquet(f"{target}/postings").drop("batch")
    lengths = spark.read.parquet(f"{target}/lengths")
    return Index(postings, postings.groupBy("term").agg(F.count("*").alias("df")), lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))
