"""Retrieval as a whole: strategies over a knowledge base's tables, and search over its graph.

A strategy is a function from (tables, queries, options) to (query_id, id, score, rank), a graph backend one from (edges,
queries, entities, options) to triples with their sources; both are entered by name, so that users bring their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.functions import text as X
from corvina.functions import vector as V
from corvina.operators import bm25, graph, search
from corvina.operators.containment import containing
from corvina.session import saved

Strategy = Callable[["Tables", DataFrame, dict[str, Any]], DataFrame]
Backend = Callable[[DataFrame, DataFrame, DataFrame, dict[str, Any]], DataFrame]


@dataclass(frozen=True)
class Tables:
    """chunks (id, content, vector), their keyword index, edges, and (query_id, name) of the entities of queries."""

    chunks: DataFrame
    index: bm25.Index | None = None
    edges: DataFrame | None = None
    entities: DataFrame | None = None


@dataclass(frozen=True)
class Options:
    """What a request asks for; steps after the strategy run in the order of these fields."""

    k: int = 10
    strategy: dict[str, Any] = field(default_factory=dict)
    rerank: bool = False
    rerank_threshold: float = 0.0
    entity_penalty: float | None = None
    l2_distance: float | None = None


def edge_backend(edges: DataFrame, queries: DataFrame, entities: DataFrame, options: dict[str, Any]) -> DataFrame:
    """(query_id, subject, predicate, object, source_node_id): relations between the entities where a query has two, else what is near its one.

    With ``hops`` over 1 the entities' first neighbours are looked at too. ``most`` bounds the triples of a name.
    """
    named = entities.select("query_id", "name").distinct()
    if options.get("hops", 1) > 1:
        near = graph.expand_entities(edges, named.select("name").distinct())
        wider = named.join(near, "name").select("query_id", F.col("other").alias("name"))
        singles = named.unionByName(wider).distinct()
    else:
        singles = named
    ends = named.groupBy("query_id").agg(F.sort_array(F.collect_set("name")).alias("e"))
    pairs = ends.where("size(e) = 2").select("query_id", F.col("e")[0].alias("e1"), F.col("e")[1].alias("e2"))
    others = singles.join(pairs.select("query_id"), "query_id", "left_anti")
    keys = ["subject", "predicate", "object"]
    between = graph.relations_between(edges, pairs.select("e1", "e2").distinct()).join(pairs, ["e1", "e2"]).select("query_id", *keys)
    around = graph.neighbors(edges, others.select("name").distinct(), options.get("most", 100)).join(others, "name").select("query_id", *keys)
    return between.unionByName(around).distinct().join(edges.select(*keys, "source_node_id").distinct(), keys).select("query_id", *keys, "source_node_id")


def graph_retrieve(tables: Tables, queries: DataFrame, options: dict[str, Any], backend: Backend = edge_backend) -> DataFrame:
    """(query_id, id, score, rank, original_score, n_triples, clickable): chunks that the graph tells about, nearest first.

    queries: (query_id, query_vec, keywords). A query's triples go where none matches its keywords. Chunks score their
    cosine to the query, raised by half and held at 1; ``k`` of each query are returned. Every row has the number of the
    query's triples and the entities that are nodes there; a query without chunks keeps one row with a null id and score 0.
    """
    found = graph.relevance_gate(queries.select("query_id", "keywords"), backend(tables.edges, queries, tables.entities, options))
    wanted = found.where("source_node_id is not null").select("query_id", X.normalize_chunk_ref(F.col("source_node_id")).alias("id")).distinct()
    rows = search.fetch_chunks(wanted, tables.chunks.select("id", "vector"), options.get("fetch", 100)).join(queries.select("query_id", "query_vec"), "query_id")
    scored = rows.select("query_id", "id", F.when(F.col("vector").isNull(), 0.0).otherwise(V.cosine(F.col("vector"), F.col("query_vec"))).alias("score"))
    best = search.ranked(search.graph_boost(scored)).where(F.col("rank") <= options.get("k", 10))
    told = found.select("query_id", "subject", "predicate", "object").distinct()
    counts = told.groupBy("query_id").agg(F.count("*").alias("n_triples"))
    ends = told.select("query_id", F.explode(F.array("subject", "object")).alias("name")).distinct()
    nodes = tables.entities.join(ends, ["query_id", "name"]).groupBy("query_id").agg(F.sort_array(F.collect_set("name")).alias("clickable"))
    whole = queries.select("query_id").join(counts, "query_id", "left").join(nodes, "query_id", "left").join(best, "query_id", "left")
    none = F.array().cast("array<string>")
    return whole.select("query_id", "id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("rank", F.lit(1)).alias("rank"), "original_score", F.coalesce("n_triples", F.lit(0)).alias("n_triples"), F.coalesce("clickable", none).alias("clickable"))


def _keyword(t: Tables, queries: DataFrame, o: dict[str, Any]) -> DataFrame:
    return bm25.bm25_search(t.index, queries, o["k"])


def _vector(t: Tables, queries: DataFrame, o: dict[str, Any]) -> DataFrame:
    return search.knn_exact(t.chunks, queries, o["k"], o.get("metric", "COSINE"), o.get("threshold"), "id", "vector")


def _hybrid(t: Tables, queries: DataFrame, o: dict[str, Any]) -> DataFrame:
    """Ranks of both searches fused; or, with ``sequential``, keyword candidates ranked by vectors."""
    words = bm25.bm25_search(t.index, queries, o.get("bm25_top", 50) if o.get("sequential") else 3 * o["k"])
    if o.get("sequential"):
        return search.hybrid_sequential(words, t.chunks.select("id", "vector"), queries, o["k"], o.get("bm25_top", 50)).select("query_id", "id", "score", "rank")
    return search.rrf_fuse([words, search.knn_exact(t.chunks, queries, 3 * o["k"], id_col="id", vector_col="vector")], top=o["k"])


def _two_stage(t: Tables, queries: DataFrame, o: dict[str, Any]) -> DataFrame:
    """Vector candidates in the order of a scorer, by default the share of the query's tokens that a chunk has."""
    few = search.knn_exact(t.chunks, queries, o.get("candidates", 5 * o["k"]), id_col="id", vector_col="vector")
    return search.two_stage(_overlap(t, queries, few), "raw", o["k"], o.get("threshold", 0.0)).select("query_id", "id", "score", "rank")


def _graph(t: Tables, queries: DataFrame, o: dict[str, Any]) -> DataFrame:
    return graph_retrieve(t, queries, o, o.get("backend", edge_backend)).where("id is not null").select("query_id", "id", "score", "rank")


STRATEGIES: dict[str, Strategy] = {"keyword": _keyword, "vector": _vector, "hybrid": _hybrid, "2-stage": _two_stage, "graph": _graph}


def _overlap(t: Tables, queries: DataFrame, results: DataFrame) -> DataFrame:
    words = queries.select("query_id", X.tokens(F.col("query_text")).alias("__q"))
    rows = results.join(t.chunks.select("id", X.tokens(F.col("content")).alias("__c")), "id").join(words, "query_id")
    return rows.withColumn("raw", search.token_overlap(F.col("__q"), F.col("__c"))).drop("__q", "__c")


def retrieve(name: str, tables: Tables, queries: DataFrame, options: Options = Options(), strategies: dict[str, Strategy] = STRATEGIES) -> DataFrame:  # noqa: B008
    """(query_id, id, score, rank) by the strategy of that name (vector where it isn't known), re-ranked, filtered and measured as asked.

    queries: (query_id, query_text, query_vec, and what the strategy needs). Re-ranking (not after 2-stage, which has its own)
    scales a scorer's values and drops those below the threshold; the entity filter multiplies the scores of chunks that share
    none of the query's entities (those of its text, by their form); the exact distance keeps what is near enough.
    """
    k = options.k
    now = strategies.get(name, strategies["vector"])(tables, queries, {"k": k, **options.strategy})
    if options.rerank and name != "2-stage":
        now = search.rerank(_overlap(tables, queries, now), "raw", k, options.rerank_threshold)
        now = now.select("query_id", "id", F.col("rerank_score").alias("score"), "rank")
    if options.entity_penalty is not None:
        asked = queries.select("query_id", X.extract_entities(F.col("query_text")).alias("__qe"))
        rows = now.join(asked, "query_id").join(tables.chunks.select("id", X.extract_entities(F.col("content")).alias("__ce")), "id")
        now = search.entity_filter(rows, "__qe", "__ce", options.entity_penalty).select("query_id", "id", "score", "rank")
    if options.l2_distance is not None:
        now = search.brute_force_l2(now, tables.chunks.select("id", "vector"), queries, k, options.l2_distance).select("query_id", "id", "score", "rank")
    return now


def resolve_labels(mentions: DataFrame, labels: DataFrame, nodes: DataFrame, instance: str = "/inst/", most: int = 2) -> DataFrame:
    """(query_id, uri, token): the first ``most`` mentions of each query that are instances.

    mentions: (query_id, pos, token); labels: (uri, label); nodes: (uri). A token's candidates are the uris whose label
    contains it, whatever the case; where there is none, the instances whose uri does. Of candidates the best-linked one
    counts (equal, then beginning with it, then containing it; nearest in length; ties by name and uri), and it counts only
    if it is an instance.
    """
    tokens = mentions.select("token").where("token <> ''").distinct()
    named = saved(_best_candidates(tokens, labels.select("uri", F.col("label").alias("name"))), "named")
    rest = tokens.join(named, "token", "left_anti")
    # characters before the local name hold no names
    local = nodes.where(F.col("uri").contains(instance)).select("uri", F.substring_index("uri", "/", -1).alias("name"))
    found = named.unionByName(_best_candidates(rest, local)).where(F.col("uri").contains(instance))
    place = F.row_number().over(search.Window.partitionBy("query_id").orderBy("pos", "token"))
    return mentions.join(found, "token").withColumn("n", place).where(F.col("n") <= most).select("query_id", "uri", "token")


def _best_candidates(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """(token, uri) of the best name that contains each token."""
    t = tokens.select("token", F.lower("token").alias("t"))
    # of names that differ in case only, the first and its first uri come before the others for every token
    n = names.where("name <> ''").groupBy(F.lower("name").alias("c")).agg(F.min(F.struct("name", "uri")).alias("id"))
    met = containing(t.select(F.lit(0).alias("scope"), F.col("t").alias("pattern")), n.select(F.lit(0).alias("scope"), "id", F.col("c").alias("text")))
    met = met.select(F.col("pattern").alias("t"), F.lower("id.name").alias("c"), "id.name", "id.uri")
    base = F.when(F.col("t") == F.col("c"), 100).when(F.col("c").startswith(F.col("t")), 60).otherwise(30)
    score = base + F.greatest(F.lit(0), 20 - (F.length("c") - F.length("t")))
    best = met.groupBy("t").agg(F.min(F.struct((-score).alias("s"), "name", "uri")).alias("b"))
    return t.join(best, "t").select("token", "b.uri")


# The heading of the triples, the text for a part that is missing, and the mark of a chunk.
HEADING, MISSING, CHUNK = "### Graph Relationships (Derived from Knowledge Graph):", "?", "[Chunk "


def answer_context(results: DataFrame, chunks: DataFrame, triples: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, context): the triples of a query (query_id, ord, subject, predicate, object) as lines, then its first chunks' contents.

    results: (query_id, id, rank); chunks: (id, content). A query without triples has no heading; one without either is absent.
    """
    part = [F.coalesce(c, F.lit(MISSING)) for c in ("subject", "predicate", "object")]
    lines = triples.select("query_id", "ord", F.concat(F.lit("- "), F.concat_ws(" ", *part)).alias("line"))
    told = lines.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("l"))
    told = told.select("query_id", F.concat(F.lit(HEADING + "\n"), F.array_join("l.line", "\n"), F.lit("\n")).alias("text"), F.lit(0).alias("n"))
    few = results.where(F.col("rank") <= most).join(chunks.select("id", "content"), "id")
    place = F.row_number().over(search.Window.partitionBy("query_id").orderBy("rank"))
    texts = few.withColumn("n", place).select("query_id", F.concat(F.lit(CHUNK), F.col("n").cast("string"), F.lit("] "), F.coalesce("content", F.lit(""))).alias("text"), "n")
    parts = told.unionByName(texts).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("p"))  # no more than ``most`` and one
    return parts.select("query_id", F.array_join("p.text", "\n\n").alias("context"))
