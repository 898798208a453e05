"""Joins that keep frequent keys apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of a frequent key are dealt to.
SALTS = 1_024


def frequent_limit(rows: int) -> int:
    """Rows of a key from which it is frequent: no more than a thousand keys can have more."""
    return max(1_000, rows // 1_000)


def join_counted(rows: DataFrame, table: DataFrame, key: str, n: str, limit: int, spread: str) -> DataFrame:
    """``rows`` with the columns of ``table`` that has one row for each key, null where a key is missing there.

    Column ``n`` of table is the number of rows with the key. Keys with more than ``limit`` rows, which are few, reach the
    rows by a broadcast, and these rows are dealt by the hash of column ``spread``; all others meet in a shuffle.
    """
    more = [c for c in table.columns if c not in (key, n)]
    hot = table.where(F.col(n) > limit).select(F.col(key).alias("__key"), F.struct(*more).alias("__hot"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("__key"), "left")
    salt = F.when(F.col("__key").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(SALTS))).cast("int")
    cool = table.where(F.col(n) <= limit).select(key, F.lit(0).alias("__salt"), F.struct(*more).alias("__cool"))
    both = marked.withColumn("__salt", salt).join(cool, [key, "__salt"], "left")
    return both.select(*rows.columns, *[F.coalesce(F.col("__hot")[c], F.col("__cool")[c]).alias(c) for c in more])
