"""Keyword search with an inverted index held as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions.text import tokens
from corvina.session import saved


@dataclass(frozen=True)
class Index:
    """postings (id, term, tf, dl), terms (term, df) and stats (one row: n, avgdl)."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def build_inverted_index(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Texts are tokenised once; postings and document frequencies are saved tables, which any number of searches read.

    Texts are dealt by their ids before they fall into tokens, so that postings need no further shuffle and those of a
    document lie together. A row without a term counts the texts of an id and length.
    """
    texts = chunks.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition("id")
    t = texts.select("id", tokens(F.col("text")).alias("t")).select("id", F.size("t").alias("dl"), "t")
    none = F.array().cast("array<string>")
    marked = t.select("id", "dl", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("t", none))).alias("term"))
    every = saved(marked.groupBy("id", "dl", "term").agg(F.count("*").alias("tf")), "postings")
    postings = every.where("term is not null").select("id", "dl", "term", "tf")
    terms = saved(postings.groupBy("term").agg(F.count("*").alias("df")), "terms")
    known = F.when(F.col("dl").isNotNull(), F.col("tf"))
    stats = every.where("term is null").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), (F.sum(F.col("dl") * F.col("tf")) / F.sum(known)).alias("avgdl"))
    return Index(postings, terms, saved(stats, "stats"))


def term_weights(index: Index) -> DataFrame:
    """(term, idf); a negative idf becomes a quarter of the mean idf over all terms."""
    raw = index.terms.join(F.broadcast(index.stats)).select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.join(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25_search(index: Index, queries: DataFrame, k: int | None = 10, k1: float = 1.5, b: float = 0.75, query_id: str = "query_id", query_text: str = "query_text") -> DataFrame:
    """(query_id, id, score, rank): Okapi scores above 0, summed over query tokens with repetition; ties by id."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    # saved, so that its size is known: where it fits a broadcast, postings are not shuffled, and a document's hits add up where they lie
    weighed = saved(asked.join(term_weights(index), "term"), "weighed")
    hits = index.postings.join(weighed, "term").join(F.broadcast(index.stats))
    part = F.col("qf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scores = hits.groupBy("query_id", "id").agg(F.sum(part).alias("score")).where("score > 0")
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    ranked = scores.withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k) if k else ranked


def attach_keywords(results: DataFrame, queries: DataFrame, query_id: str = "query_id", query_text: str = "query_text") -> DataFrame:
    return results.join(queries.select(F.col(query_id).alias("query_id"), tokens(F.col(query_text)).alias("keywords"), F.lit("whitespace").alias("tokenizer")), "query_id")
