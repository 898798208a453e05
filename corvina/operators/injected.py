"""Injected functions: extractors, tokenizers, embedders and scorers that a user brings.

Such a function gets a batch of rows as a dict of lists and returns one value for each row, of a declared type. Where it
fails on a batch, its rows are tried one by one; a row on which it fails keeps a null value and the error's text, and the
job goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from corvina.session import saved

Injected = Callable[[dict[str, list]], list]

#: Rows that reach a function at once.
BATCH = 256


def _one_by_one(work: Injected, rows: dict[str, list], n: int, kind: pa.DataType) -> tuple[list, list]:
    values: list[Any] = []
    errors: list[str | None] = []
    for i in range(n):
        try:
            (value,) = work({c: [v[i]] for c, v in rows.items()})
            pa.array([value], kind)  # a value of another type is an error too
            values.append(value)
            errors.append(None)
        except Exception as e:  # whatever a user's function raises belongs to its row
            values.append(None)
            errors.append(f"{type(e).__name__}: {e}"[:500])
    return values, errors


def apply_injected(rows: DataFrame, work: Injected, columns: list[str], declared: str, batch: int = BATCH) -> DataFrame:
    """``rows`` with a column as ``declared`` (name and type) and ``error``, null where the function gave a value."""
    (field,) = StructType(_parse_datatype_string(declared).fields).fields
    kind = to_arrow_type(field.dataType)
    schema = StructType([*(f for f in rows.schema.fields if f.name not in (field.name, "error")), field, StructField("error", StringType())])
    kept = [f.name for f in schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                given = {c: b.column(c).to_pylist() for c in columns}
                try:
                    values, errors = list(work(given)), [None] * b.num_rows
                    if len(values) != b.num_rows:
                        raise ValueError(f"{len(values)} values for {b.num_rows} rows")
                    made = pa.array(values, kind)
                except Exception:  # found out row by row
                    values, errors = _one_by_one(work, given, b.num_rows, kind)
                    made = pa.array(values, kind)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), made, pa.array(errors, pa.string())], names=[*kept, field.name, "error"])

    return rows.select(*{c: None for c in [*kept, *columns]}).mapInArrow(run, schema)


def extract_triples(chunks: DataFrame, extractor: Callable[[list[str]], list[list[dict]]], id_col: str = "chunk_id", text_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """(chunk_id, pos, subject, predicate, object, confidence) by an injected extractor of texts, and (chunk_id, error) of those it failed on.

    The extractor gives each text a list of dicts with these names; a confidence that is absent is 0.8, and triples that lack
    an end or a predicate go. Its replies are saved, as both tables come of them: it sees each text once.
    """
    kind = "found array<struct<subject: string, predicate: string, object: string, confidence: double>>"
    rows = chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("content"))
    done = apply_injected(rows, lambda b: extractor(b["content"]), ["content"], kind)
    done = saved(done.drop("content"), "extracted")
    told = done.select("chunk_id", F.posexplode("found").alias("pos", "t")).select("chunk_id", "pos", "t.subject", "t.predicate", "t.object", F.coalesce("t.confidence", F.lit(0.8)).alias("confidence"))
    return told.where("subject is not null and predicate is not null and object is not null"), done.where("error is not null").select("chunk_id", "error")


def analyse(texts: DataFrame, analyser: Callable[[list[str]], list[list[tuple[str, str]]]], text_col: str = "text") -> DataFrame:
    """``texts`` with ``analysed``, the tokens (form, tag) of an injected analyser, for ``tagged_tokens`` and ``merge_proper_nouns``."""
    def work(b: dict[str, list]) -> list:
        return [[{"form": f, "tag": t} for f, t in tokens] for tokens in analyser(b[text_col])]

    return apply_injected(texts, work, [text_col], "analysed array<struct<form: string, tag: string>>")
