"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of complete groups from batches that are sorted by key; a group that goes on in the next batch waits for it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if held and held[0].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def group_slices(keys: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    ends = np.concatenate([cut, [len(keys)]])
    return list(zip(np.concatenate([[0], cut]).tolist(), ends.tolist(), strict=True))


def bounded_sample(df: DataFrame, at_most: int, *key: str) -> list:
    """At most so many rows, those with the smallest hashes of key: the same rows whatever the partitioning."""
    return df.withColumn("__h", F.xxhash64(*key)).orderBy("__h", *key).limit(at_most).drop("__h").collect()


def text_bytes(df: DataFrame, text_col: str) -> int:
    return df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def task_count(spark: SparkSession, n_bytes: int, each: int = 64 << 20) -> int:
    """Tasks for so many bytes: as many as are configured, and more where one would get more than ``each``."""
    configured = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(configured, -(-n_bytes // each))
