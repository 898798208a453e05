"""Deleting, checking and measuring a corpus; the memory of query examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def delete_documents(table: DataFrame, doc_ids: DataFrame, column: str = "doc_id") -> DataFrame:
    return table.join(doc_ids.select(F.col("doc_id").alias(column)), column, "left_anti")


def orphan_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    used = edges.select(F.explode(F.array("subject", "object")).alias("node"))
    return nodes.join(used, "node", "left_anti")


def verify_cleanup(tables: dict[str, DataFrame], doc_ids: DataFrame) -> DataFrame:
    """(table, residual): rows that still belong to the documents."""
    out = None
    for name, df in sorted(tables.items()):
        part = df.join(doc_ids, "doc_id", "left_semi").agg(F.count("*").alias("residual")).select(F.lit(name).alias("table"), "residual")
        out = part if out is None else out.unionByName(part)
    return out


def orphans(rows: DataFrame, parents: DataFrame, column: str) -> DataFrame:
    return rows.join(parents.select(column).distinct(), column, "left_anti")


def qa_metrics(chunks: DataFrame, candidates: DataFrame, least: float = 0.5) -> DataFrame:
    """(metric, value): documents, chunks, the mean of the documents' mean lengths, and the share of candidates filtered out."""
    per_doc = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.avg(F.length("content")).alias("mean"))
    a = per_doc.agg(F.count("*").cast("double").alias("documents"), F.sum("n").cast("double").alias("chunks"), F.avg("mean").alias("mean_length"))
    b = candidates.agg(F.count("*").cast("double").alias("candidates"), F.avg((F.col("confidence") < least).cast("double")).alias("filter_ratio"))
    one = a.select(F.expr("stack(3, 'documents', documents, 'chunks', chunks, 'mean_length', mean_length) as (metric, value)"))
    return one.unionByName(b.select(F.expr("stack(2, 'candidates', candidates, 'filter_ratio', filter_ratio) as (metric, value)")))


def ingest_counts(nodes: DataFrame, triples: DataFrame) -> DataFrame:
    n = nodes.groupBy("doc_id").agg(F.count("*").alias("node_count"))
    t = triples.groupBy("doc_id").agg(F.count("*").alias("triple_count"), F.countDistinct("subject").alias("entity_count"))
    return n.join(t, "doc_id", "full").na.fill(0)


def example_evict(examples: DataFrame, most: int = 200) -> DataFrame:
    """Of each (kb, backend) the most used examples stay, the newer of equally used ones."""
    place = Window.partitionBy("kb", "backend").orderBy(F.desc("use_count"), F.desc("created_at"), "id")
    return examples.withColumn("n", F.row_number().over(place)).where(F.col("n") <= most).drop("n")


#: Examples and queries of a (kb, backend) that one cell compares.
EXAMPLE_BLOCK, QUERY_BLOCK = 50_000, 10_000


def example_search(examples: DataFrame, queries: DataFrame, k: int = 3, least: float = 0.7) -> DataFrame:
    """(query_id, id, score, rank): examples of the same kb and backend with a cosine of at least ``least``.

    Examples and queries of a kb and backend are dealt to blocks of bounded size and meet in cells, more of them where there
    are more pairs. A cell keeps what can be among the best k of each query.
    """
    from corvina.operators.nearest import nearest_in_cells
    from corvina.operators.search import ranked

    group = ["kb", "backend"]
    wanted = 3 * examples.sparkSession.sparkContext.defaultParallelism
    sizes = examples.groupBy(group).agg(F.count("*").alias("n")).join(queries.groupBy(group).agg(F.count("*").alias("m")), group)
    pairs = sizes.agg(F.sum(F.col("n").cast("double") * F.col("m")).alias("pairs"))  # one row
    blocks = F.ceil(F.col("n") / EXAMPLE_BLOCK).cast("int")
    parts = F.greatest(F.ceil(F.col("m") / QUERY_BLOCK), F.ceil(wanted * F.col("n") * F.col("m") / F.col("pairs") / blocks)).cast("int")
    sizes = sizes.join(F.broadcast(pairs)).select(*group, blocks.alias("blocks"), parts.alias("parts"))
    total = sizes.agg(F.sum(F.col("blocks").cast("long") * F.col("parts"))).first()[0] or 1

    def dealt(rows: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        return rows.join(sizes, group).withColumn(own, F.pmod(F.xxhash64("__id"), F.col(own_n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))

    cell = F.xxhash64(*group, "block", "part").alias("cell")
    held = dealt(examples.withColumn("__id", F.col("id")), "block", "blocks", "part", "parts").select(cell, "id", F.col("question_vector").alias("v"))
    asked = dealt(queries.withColumn("__id", F.col("query_id")), "part", "parts", "block", "blocks").select(cell, "query_id", F.col("query_vec").alias("v"))
    few = nearest_in_cells(held, asked, min(total, 10 * wanted), k, "COSINE", False).where(F.col("score") >= least)
    return ranked(few).where(F.col("rank") <= k)


def example_store(examples: DataFrame, new: DataFrame, least: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(id, hits) of examples that new rows repeat, and the new rows that are to be added; new: (query_id, kb, backend, query_vec)."""
    best = example_search(examples, new, 1, least)
    hits = best.groupBy("id").agg(F.count("*").alias("hits"))
    return hits, new.join(best.select("query_id"), "query_id", "left_anti")


def delete_kb(tables: dict[str, DataFrame], kb: str) -> dict[str, DataFrame]:
    return {name: df.where(~F.col("kb_id").eqNullSafe(F.lit(kb))) for name, df in tables.items()}
