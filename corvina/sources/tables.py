"""Reading documents and writing or exporting chunks, triples and graphs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from corvina.functions import text as X
from corvina.functions.yaml_text import yaml_to_json
from corvina.session import saved


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, file_type) of text and Markdown files, a row for each; doc_id is the file's stem."""
    raw = spark.read.text(path, wholetext=True).withColumn("__f", F.substring_index(F.input_file_name(), "/", -1))
    stem = F.url_decode(F.regexp_replace("__f", r"\.[^.]*$", ""))
    return raw.select(stem.alias("doc_id"), F.col("value").alias("text"), F.lower(F.regexp_extract("__f", r"\.([^.]*)$", 1)).alias("file_type"))


@F.pandas_udf(StringType())
def json_of_yaml(text: pd.Series) -> pd.Series:
    return text.map(yaml_to_json).astype(object)


def structured_body(text: Column, file_type: Column) -> Column:
    """A record's text as a variant: JSON, or YAML where the file's ending says so or it isn't JSON; null if it is neither."""
    return F.when(file_type == "json", F.try_parse_json(text)).when(file_type.isin("yaml", "yml"), F.try_parse_json(json_of_yaml(text))).otherwise(
        F.coalesce(F.try_parse_json(text), F.try_parse_json(json_of_yaml(text)))
    )


def read_structured(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, body) of JSON and YAML files, a row for each; body is null where the text can't be read."""
    docs = read_documents(spark, path)
    return docs.where(F.col("file_type").isin("json", "yaml", "yml")).select("doc_id", structured_body(F.col("text"), F.col("file_type")).alias("body"))


def chunk_records(chunks: DataFrame) -> DataFrame:
    """Chunk rows as they are written: nulls as -1 and empty texts."""
    whole = {c: F.coalesce(c, F.lit(-1)) for c in ("page", "start_offset", "end_offset") if c in chunks.columns}
    return chunks.withColumns(whole | {"section_path": F.coalesce("section_path", F.lit(""))})


def chunks_from_records(records: DataFrame) -> DataFrame:
    """The reverse: negative numbers and empty paths are null."""
    whole = {c: F.when(F.col(c) >= 0, F.col(c)) for c in ("page", "start_offset", "end_offset") if c in records.columns}
    return records.withColumns(whole | {"section_path": F.nullif("section_path", F.lit(""))})


def write_chunks_jsonl(chunks: DataFrame, path: str) -> None:
    chunk_records(chunks).write.json(path)


def read_chunks_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return chunks_from_records(spark.read.schema(schema).json(path))


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    """chunk_id is the node's id, else document and index."""
    return chunks.withColumn("chunk_id", F.coalesce("node_id", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("idx").cast("string"))))


def write_chunks(chunks: DataFrame, path: str, kb: str) -> None:
    with_chunk_ids(chunks).withColumn("kb_id", F.lit(kb)).write.mode("append").partitionBy("kb_id").parquet(path)


def save_stage(df: DataFrame, root: str, stage: str, kb: str, doc: str) -> str:
    """A stage's rows of one document, in place of those saved before; returns the folder."""
    path = f"{root}/stage={stage}/kb={kb}/doc={doc}"
    df.write.mode("overwrite").parquet(path)
    return path


def load_stage(spark: SparkSession, root: str, stage: str, kb: str, doc: str) -> DataFrame:
    return spark.read.parquet(f"{root}/stage={stage}/kb={kb}/doc={doc}")


#: Folders that the documents of a knowledge base and stage are dealt to, by a hash of their ids.
STAGE_PARTS = 64


def _finished(spark: SparkSession, root: str, stage: str, kb: str, kind: DataType) -> DataFrame:
    """(doc_id) of the documents whose rows of a stage are complete."""
    try:
        return spark.read.parquet(f"{root}/done/stage={stage}/kb={kb}").select("doc_id").distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # nothing is finished yet
            raise
        return spark.createDataFrame([], StructType([StructField("doc_id", kind)]))


def resume_stages(docs: DataFrame, root: str, kb: str, stages: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], run: str) -> tuple[DataFrame, dict[str, int]]:
    """The last stage's rows of all docs (doc_id, …), and how many documents each stage worked on in this run.

    A stage is a name and a function from the rows before it to its own, which must keep doc_id. Its rows are saved below
    ``root`` before their documents are marked as done, so a document whose run broke off is worked on again and its rows
    come once: a run writes folders of its own name in place of what it left there before, and rows count only from the run
    that finished their document. Documents that are done already aren't read again.
    """
    spark, now, worked = docs.sparkSession, docs, {}
    kind = docs.schema["doc_id"].dataType
    for stage, work in stages:
        done = _finished(spark, root, stage, kb, kind)
        open_ = now.join(done, "doc_id", "left_anti")
        ids = saved(docs.select("doc_id").distinct().join(done, "doc_id", "left_anti"), "open")
        worked[stage] = ids.count()
        place = f"{root}/rows/stage={stage}/kb={kb}"
        if worked[stage]:
            part = F.pmod(F.xxhash64("doc_id"), F.lit(STAGE_PARTS)).cast("int")
            work(open_).withColumns({"part": part, "run": F.lit(run)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "part").parquet(place)
            ids.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{root}/done/stage={stage}/kb={kb}")
        marks = spark.read.parquet(f"{root}/done/stage={stage}/kb={kb}").groupBy("doc_id").agg(F.min("run").alias("run"))
        rows = spark.read.option("basePath", place).parquet(place).withColumn("run", F.col("run").cast("string"))
        now = rows.join(marks, ["doc_id", "run"], "left_semi").join(docs.select("doc_id").distinct(), "doc_id", "left_semi").drop("part", "run")
    return now, worked


def append_attempts(attempts: DataFrame, path: str) -> None:
    attempts.select("query", "error", "result_count", "elapsed_ms", "succeeded").write.mode("append").parquet(path)


def property_graph(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (iri, label, properties) and relations (subject, type, object); triples: (subject, predicate, object, is_literal)."""
    links = triples.where("not is_literal")
    ends = links.select(F.explode(F.array("subject", "object")).alias("iri")).union(triples.select("subject")).distinct()
    facts = triples.where("is_literal").groupBy(F.col("subject").alias("iri")).agg(F.array_sort(F.collect_set(F.concat("predicate", F.lit("="), "object"))).alias("properties"))
    nodes = ends.join(facts, "iri", "left").select("iri", X.local_name(F.col("iri")).alias("label"), F.coalesce("properties", F.array().cast("array<string>")).alias("properties"))
    kind = F.upper(F.regexp_replace("predicate", "[^a-zA-Z0-9_가-힣]", "_"))
    kind = F.when((kind == "") | (kind == "TYPE"), "RELATED_TO").otherwise(kind)
    return nodes, links.select("subject", kind.alias("type"), "object").distinct()


def export_union_graph(quads: DataFrame, schema_graph: str = "urn:ontology:") -> DataFrame:
    return quads.where(~F.col("g").startswith(schema_graph)).select("s", "p", "o").distinct()


def export_edges(edges: DataFrame, base: str = "urn:export:") -> DataFrame:
    """(s, p, o): label rows of nodes and predicates, and a row for each edge, with percent-encoded names."""

    def uri(c, kind):
        return F.concat(F.lit(f"{base}{kind}/"), F.replace(F.url_encode(F.replace(c, F.lit(" "), F.lit("_"))), F.lit("+"), F.lit("%20")))

    rows = edges.select(uri(F.col("subject"), "inst").alias("su"), uri(F.col("predicate"), "rel").alias("pu"), uri(F.col("object"), "inst").alias("ou"), "subject", "predicate", "object")
    listed = F.array(*[F.struct(F.col(a).alias("s"), b.alias("p"), F.col(c).alias("o")) for a, b, c in (
        ("su", F.lit("label"), "subject"), ("pu", F.lit("label"), "predicate"), ("ou", F.lit("label"), "object"), ("su", F.col("pu"), "ou"))])
    return rows.select(F.inline(listed)).distinct()
