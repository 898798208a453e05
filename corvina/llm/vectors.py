"""Which vectors take part in searches and comparisons."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part: not null, finite in all components, not zero, of the commonest length."""
    v = F.col(vector_col).cast("array<double>")
    good = df.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where(F.col("vector").isNotNull() & F.col("id").isNotNull())
    good = good.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    top = good.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return good.where(F.size("vector") == (top[0] if top else 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
