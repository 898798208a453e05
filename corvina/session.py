"""Places on shared storage for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a local session has a new temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        place = getattr(spark, "_corvina_dir", None)
        if place is None:
            place = "file://" + tempfile.mkdtemp(prefix="spark-corvina-")
            spark._corvina_dir = place
    return place.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def tasks_of(spark: SparkSession) -> int:
    """Tasks for rows that are much work for few bytes: a shuffle by size would leave one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: its lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
