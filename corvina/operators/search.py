"""Vector search, fusion of ranked lists and re-ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions import vector as V
from corvina.operators.injected import apply_injected
from corvina.operators.nearest import nearest_in_cells
from corvina.session import saved

Scorer = Callable[[Column, Column], Column]


def ranked(df: DataFrame, score: str = "score", by: str = "query_id", tie: str = "id", name: str = "rank") -> DataFrame:
    """1-based ranks; scores are compared to nine digits, then ids."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round(score, 9)), tie)))


#: Rows and queries of a cell of the exact search.
KNN_BLOCK, KNN_QUERIES = 50_000, 10_000


def knn_exact(chunks: DataFrame, queries: DataFrame, k: int, metric: str = "COSINE", threshold: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank) for stated queries (query_id, query_vec) against all chunks.

    Chunks and queries are dealt by hashes of their ids, and meet in cells of bounded size; a cell keeps what can be among the
    best k of each query before the cells' results meet. Work is that of all pairs, as the search is exact.
    """
    spark, n, m = chunks.sparkSession, chunks.count(), queries.count()
    wanted = 3 * spark.sparkContext.defaultParallelism
    # as many blocks of rows as copy least of both, where a query's results from a block count like copies
    rows = max(1, -(-n // KNN_BLOCK), min(wanted, round((wanted * n / max(1, m * (1 + k / 8))) ** 0.5)))
    parts = max(1, -(-m // KNN_QUERIES), -(-wanted // rows))
    own, part = F.pmod(F.xxhash64(id_col), F.lit(rows)), F.pmod(F.xxhash64("query_id"), F.lit(parts))
    held_in = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: own * parts + p)
    asked_in = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: r * parts + part)
    held = chunks.select(F.explode(held_in).alias("cell"), F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    asked = queries.select(F.explode(asked_in).alias("cell"), "query_id", F.col("query_vec").alias("v"))
    few = nearest_in_cells(held, asked, rows * parts, k, metric, threshold is None)
    if threshold is not None:
        few = few.where(F.col("score") >= threshold)
    return ranked(few).where(F.col("rank") <= k)


def rescore_candidates(results: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, metric: str = "COSINE", threshold: float = 0.0, stage: str = "ANN") -> DataFrame:
    """Replaces scores by similarities; drops those below the threshold; remembers them in ``history``."""
    value = {"COSINE": V.cosine, "IP": V.inner, "L2": V.l2}[metric](F.col("v"), F.col("query_vec"))
    rows = results.join(vectors.select("id", F.col("vector").alias("v")), "id").join(queries.select("query_id", "query_vec"), "query_id")
    old = F.col("history") if "history" in results.columns else F.create_map().cast("map<string,double>")
    new = V.score_from_metric(value, metric)
    rows = rows.withColumn("score", new).where(F.col("score") >= threshold).withColumn("history", F.map_concat(F.map_filter(old, lambda s, _: s != stage), F.create_map(F.lit(stage), F.col("score"))))
    return ranked(rows.select("query_id", "id", "score", "history")).where(F.col("rank") <= k)


def brute_force_l2(results: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, max_dist: float = 1.5) -> DataFrame:
    rows = results.select("query_id", "id").join(vectors.select("id", F.col("vector").alias("v")), "id").join(queries.select("query_id", "query_vec"), "query_id")
    rows = rows.withColumn("l2_score", V.l2(F.col("v"), F.col("query_vec"))).where(F.col("l2_score") <= max_dist)
    return ranked(rows.select("query_id", "id", "l2_score", (1 / (1 + F.col("l2_score"))).alias("score"))).where(F.col("rank") <= k)


def graph_boost(results: DataFrame, factor: float = 1.5) -> DataFrame:
    return results.withColumn("original_score", F.col("score")).withColumn("score", F.least(F.col("score") * factor, F.lit(1.0)))


def fetch_chunks(wanted: DataFrame, chunks: DataFrame, most: int = 100) -> DataFrame:
    """Chunk rows for the ids asked for, the first ``most`` of each query by id."""
    few = wanted.withColumn("__n", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).where(F.col("__n") <= most)
    return few.drop("__n").join(chunks, "id")


def rrf_fuse(lists: list[DataFrame], k: int = 60, top: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): sums of 1 / (k + rank) over the lists, ranks from 1."""
    rows = None
    for one in lists:
        part = one.select("query_id", "id", (1 / (F.lit(k) + F.col("rank"))).alias("score"))
        rows = part if rows is None else rows.unionByName(part)
    out = ranked(rows.groupBy("query_id", "id").agg(F.sum("score").alias("score")))
    return out.where(F.col("rank") <= top) if top else out


def hybrid_sequential(bm25: DataFrame, vectors: DataFrame, queries: DataFrame, top: int, bm25_top: int = 50, graph: DataFrame | None = None, k: int = 60, missing: int = 9999) -> DataFrame:
    """BM25 (and graph) candidates, ranked by cosine too; both ranks fused, absent ranks count as ``missing``."""
    first = bm25.where(F.col("rank") <= bm25_top).select("query_id", "id", F.col("rank").alias("bm25_rank"))
    flagged = first.withColumn("graph", F.lit(False))
    if graph is not None:
        flagged = first.join(graph.select("query_id", "id", F.lit(True).alias("graph")), ["query_id", "id"], "full").withColumn("graph", F.coalesce("graph", F.lit(False)))
    rows = flagged.join(vectors.select("id", F.col("vector").alias("v")), "id").join(queries.select("query_id", "query_vec"), "query_id")
    rows = ranked(rows.withColumn("cosine", V.cosine(F.col("v"), F.col("query_vec"))), "cosine", name="ann_rank")
    score = 1 / (k + F.coalesce("bm25_rank", F.lit(missing))) + 1 / (k + F.col("ann_rank")) + F.when(F.col("graph"), 0.001).otherwise(0.0)
    return ranked(rows.select("query_id", "id", score.alias("score"), "cosine")).where(F.col("rank") <= top)


def merge_results(existing: DataFrame, new: DataFrame, stage: str, mode: str = "union") -> DataFrame:
    """(query_id, id, score, history): the newest score counts; ``intersection`` keeps what both have."""
    a = existing.select("query_id", "id", F.col("score").alias("old"), F.col("history"))
    b = new.select("query_id", "id", F.col("score").alias("new"))
    both = a.join(b, ["query_id", "id"], "full" if mode == "union" else "inner")
    past = F.coalesce("history", F.create_map().cast("map<string,double>"))
    now = F.when(F.col("new").isNotNull(), F.map_concat(F.map_filter(past, lambda s, _: s != stage), F.create_map(F.lit(stage), F.col("new")))).otherwise(past)
    return both.select("query_id", "id", F.coalesce("new", "old").alias("score"), now.alias("history"))


def run_pipeline(stages: list[tuple[str, dict]], start: DataFrame, registry: dict[str, Callable[..., DataFrame]]) -> DataFrame:
    """Applies the stages' functions in order (a lazy plan); names that the registry lacks are skipped."""
    now = start
    for name, options in stages:
        if name in registry:
            now = registry[name](now, **options)
    return ranked(now.drop("rank"))


def rerank(results: DataFrame, raw: str, k: int, threshold: float = 0.0, floor: float = 0.01) -> DataFrame:
    """Scores a scorer's column ``raw`` from its least to its largest value in each query; all equal: 0.5."""
    q = Window.partitionBy("query_id")
    low, high = F.min(raw).over(q), F.max(raw).over(q)
    scaled = F.when(high == low, F.lit(0.5)).otherwise((F.col(raw) - low) / F.nullif(high - low, F.lit(0.0)))
    rows = results.withColumn("rerank_score", F.greatest(F.lit(floor), scaled)).where(F.col("rerank_score") >= threshold)
    return ranked(rows.drop("rank"), "rerank_score").where(F.col("rank") <= k)


def token_overlap(query_tokens: Column, content_tokens: Column) -> Column:
    """The share of the query's distinct tokens that the content has: the default scorer."""
    return F.size(F.array_intersect(query_tokens, content_tokens)) / F.greatest(F.size(F.array_distinct(query_tokens)), F.lit(1))


def two_stage(candidates: DataFrame, raw: str, k: int, threshold: float = 0.0) -> DataFrame:
    """The first k in the scorer's order among candidates whose own score reaches the threshold; their own score stays."""
    return ranked(candidates.where(F.col("score") >= threshold).drop("rank"), raw).where(F.col("rank") <= k)


def entity_filter(results: DataFrame, query_entities: str, chunk_entities: str, penalty: float = 0.3) -> DataFrame:
    """Scores of chunks that share none of their query's entities are multiplied by the penalty."""
    miss = (F.size(query_entities) > 0) & ~F.coalesce(F.arrays_overlap(query_entities, chunk_entities), F.lit(False))
    rows = results.withColumn("original_score", F.col("score")).withColumn("score", F.when(miss, F.col("score") * penalty).otherwise(F.col("score")))
    return ranked(rows.drop("rank"))


def score_history(stages: dict[str, DataFrame]) -> DataFrame:
    """(query_id, id, history): every stage's score of each row, by the stages' names; the lists are (query_id, id, score)."""
    named = [df.select("query_id", "id", F.struct(F.lit(stage).alias("key"), F.col("score").cast("double").alias("value")).alias("e")) for stage, df in stages.items()]
    return reduce(DataFrame.unionByName, named).groupBy("query_id", "id").agg(F.map_from_entries(F.collect_list("e")).alias("history"))


def hashed_embedding(df: DataFrame, tokens: Column, id_col: str, size: int = 256) -> DataFrame:
    """(id, embedding): counts of tokens by hashed places, scaled to length 1; the offline embedder. Rows without tokens go."""
    place = F.pmod(F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")
    counts = df.select(F.col(id_col).alias("id"), F.explode(tokens).alias("token")).groupBy("id", place.alias("place")).agg(F.count("*").alias("n"))
    rows = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    value = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("norm"))
    return rows.select("id", value.alias("embedding"))


def embed(df: DataFrame, scorer: Callable[[list[str]], list], id_col: str, text_col: str) -> DataFrame:
    """(id, embedding, error) by an injected function from a batch of texts to lists of numbers; rows on which it fails keep the error."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return apply_injected(rows, lambda b: scorer(b["text"]), ["text"], "embedding array<double>").drop("text")


def rerank_injected(results: DataFrame, texts: DataFrame, queries: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], k: int, threshold: float = 0.0) -> DataFrame:
    """``rerank`` by an injected function from a batch of (query text, content) to scores; rows on which it fails go last, with score null as 0.

    results: (query_id, id, …); texts: (id, content); queries: (query_id, query_text).
    """
    rows = results.join(texts.select("id", "content"), "id").join(queries.select("query_id", "query_text"), "query_id")
    scored = apply_injected(rows, lambda b: scorer(b["query_text"], b["content"]), ["query_text", "content"], "raw double")
    return rerank(scored.withColumn("raw", F.coalesce("raw", F.lit(0.0))).drop("query_text", "content", "error"), "raw", k, threshold)


def _nearest_cells(centres: np.ndarray, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array(b.column("v").to_pylist(), dtype=np.float64).reshape(b.num_rows, -1)
            gaps = (centres**2).sum(axis=1)[None, :] - 2 * v @ centres.T
            cells = np.argsort(gaps, axis=1, kind="stable")[:, :most].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32)), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), lists], names=["id", "v", "cells"])

    return run


#: Vectors that centres are fitted on for each of them, and stated queries whose exact neighbours tell how many cells to visit.
FIT_ROWS, FIT_QUERIES = 64, 128


def ivf_cells(rows: DataFrame, nlist: int, seed: int) -> tuple[np.ndarray, DataFrame]:
    """Centres by k-means on a bounded sample of rows (id, v), and (id, v, cell) of every row by its nearest centre, saved."""
    sample = rows.withColumn("h", F.xxhash64(F.lit(seed), "id")).orderBy("h", "id").limit(FIT_ROWS * nlist).select("v")
    sample = saved(sample, "sample").select(array_to_vector("v").alias("f"))
    model = KMeans(k=nlist, seed=seed, maxIter=10, featuresCol="f", predictionCol="cell").fit(sample)
    centres = np.array(model.clusterCenters(), dtype=np.float64)
    kind = rows.schema["id"].dataType.simpleString()
    held = rows.mapInArrow(_nearest_cells(centres, 1), f"id {kind}, v array<double>, cells array<int>").select("id", "v", F.col("cells")[0].alias("cell"))
    return centres, saved(held, "cells")


def fitted_probes(held: DataFrame, centres: np.ndarray, k: int, recall: float, seed: int) -> int:
    """The least number of nearest cells in which sampled rows find the wanted share of their exact ``k`` nearest rows."""
    asked = held.withColumn("h", F.xxhash64(F.lit(seed + 1), "id")).orderBy("h", "id").limit(FIT_QUERIES).select(F.col("id").alias("query_id"), F.col("v").alias("query_vec"))
    asked = saved(asked, "asked")
    exact = knn_exact(held, asked, k, id_col="id", vector_col="v").join(held.select("id", "cell"), "id")
    ranks = asked.select(F.col("query_id").alias("id"), F.col("query_vec").alias("v")).mapInArrow(_nearest_cells(centres, len(centres)), f"id {asked.schema['query_id'].dataType.simpleString()}, v array<double>, cells array<int>")
    place = exact.join(ranks.select(F.col("id").alias("query_id"), "cells"), "query_id").select(F.array_position("cells", F.col("cell")).alias("n"))
    return int(place.agg(F.percentile("n", F.lit(recall))).first()[0] or 1) + 1  # one more than at the edge


def knn_ivf(
    chunks: DataFrame, queries: DataFrame, k: int, nlist: int = 1024, nprobe: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 1, recall: float = 0.95
) -> DataFrame:
    """(query_id, id, score, rank) by cosine among the rows of the cells nearest to each query.

    Cells belong to the centres of k-means over unit vectors; every row is in its nearest centre's cell. Without ``nprobe``
    the number of cells to visit is fitted to ``recall`` on sampled rows, whose exact neighbours are found. Centres are no
    more than ``nlist`` and reach tasks as one matrix. A cell that is much larger than the mean is cut into blocks, which its
    queries all visit. Null and zero vectors and vectors with null components take no part.
    """
    def unit(c):
        norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
        # bound to a variable, as it would be computed for each component else
        return F.transform(F.array(norm), lambda n: F.when(n > 0, F.transform(c, lambda x: x / n)))[0]

    rows = chunks.select(F.col(id_col).alias("id"), unit(F.col(vector_col).cast("array<double>")).alias("v")).where("v is not null and not exists(v, x -> x is null)")
    rows = saved(rows, "unit")
    n = rows.count()
    if not n:
        return queries.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double, rank int")
    centres, held = ivf_cells(rows, min(nlist, n), seed)
    probes = min(len(centres), nprobe or fitted_probes(held, centres, k, recall, seed))
    asked = queries.select(F.col("query_id").alias("id"), unit(F.col("query_vec").cast("array<double>")).alias("v")).where("v is not null")
    asked = asked.mapInArrow(_nearest_cells(centres, probes), f"id {queries.schema['query_id'].dataType.simpleString()}, v array<double>, cells array<int>")
    visits = asked.select(F.col("id").alias("query_id"), F.col("v").alias("query_vec"), F.explode("cells").alias("cell"))
    most = min(KNN_BLOCK, max(1_000, 4 * n // len(centres)))
    sizes = held.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))  # a row for each cell
    place = F.xxhash64("cell", "block").alias("cell")
    blocked = held.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select(place, "id", "v")
    met = visits.join(F.broadcast(sizes), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(place, "query_id", F.col("query_vec").alias("v"))
    scored = nearest_in_cells(blocked, met, 10 * queries.sparkSession.sparkContext.defaultParallelism, k, "COSINE", False)
    return ranked(scored).where(F.col("rank") <= k)


def knn_lsh(chunks: DataFrame, queries: DataFrame, k: int, bucket: float = 1.0, tables: int = 6, most_distance: float = 1.6, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 1) -> DataFrame:
    """(query_id, id, score, rank) by cosine among the rows that share a bucket of random projections with the query.

    ``most_distance`` is the Euclidean distance that a pair must stay below. Buckets are cells; those that hold more than a cell
    may are cut into blocks of rows and of queries, which all meet, and only the best k of each query leave a cell. Vectors that
    are null or hold null or non-finite components take no part.
    """
    sound = "v is not null and forall(v, x -> x is not null and x > double('-inf') and x < double('inf'))"
    rows = chunks.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(sound).dropDuplicates()
    asked = queries.select("query_id", F.col("query_vec").alias("v")).where(sound).dropDuplicates()
    n = rows.count()
    if not n:
        return queries.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double, rank int")

    def points(df):
        return df.withColumn("f", array_to_vector(F.col("v").cast("array<double>")))

    model = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(points(rows))

    def hashed(df):
        values = F.posexplode(F.transform("h", lambda h: h + 0.0)).alias("number", "value")  # 0.0 and -0.0 are one bucket
        return model.transform(points(df)).withColumn("h", F.array(*[vector_to_array(F.col("h")[i])[0] for i in range(tables)])).select(*df.columns, values)

    wanted = 3 * rows.sparkSession.sparkContext.defaultParallelism
    most = min(KNN_BLOCK, max(2_000, n * tables // wanted))
    held, met = saved(hashed(rows), "buckets"), saved(hashed(asked), "asked")
    counted = held.select("number", "value", F.lit(1).alias("r")).unionByName(met.select("number", "value", F.lit(0).alias("r"))).groupBy("number", "value")
    sizes = counted.agg(F.ceil(F.sum("r") / most).cast("int").alias("gr"), F.ceil(F.sum(1 - F.col("r")) / KNN_QUERIES).cast("int").alias("gq"))
    sizes = F.broadcast(saved(sizes.where("gr > 1 or gq > 1"), "sizes"))  # a few for each block of rows and table
    gr, gq = (F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) for c in ("gr", "gq"))
    blocks = held.join(sizes, ["number", "value"], "left").withColumns({"r": F.pmod(F.xxhash64("id"), gr), "q": F.explode(F.sequence(F.lit(0), gq - 1))})
    parts = met.join(sizes, ["number", "value"], "left").withColumns({"q": F.pmod(F.xxhash64("query_id"), gq), "r": F.explode(F.sequence(F.lit(0), gr - 1))})
    place = F.xxhash64("number", "value", F.col("r").cast("long"), F.col("q").cast("long")).alias("cell")
    few = nearest_in_cells(blocks.select(place, "id", "v"), parts.select(place, "query_id", "v"), 10 * rows.sparkSession.sparkContext.defaultParallelism, k, "COSINE", False, most_distance)
    # a pair can meet in each table; pairs of a query lie together from here on
    once = few.repartition("query_id").dropDuplicates()
    return ranked(once).where(F.col("rank") <= k)


def legacy_search(strategy: str, registry: dict[str, Callable[[], DataFrame]], steps: list[Callable[[DataFrame], DataFrame]] = (), default: str = "vector") -> DataFrame:
    """The results of the strategy's function, or the default's where the name isn't known, after further steps in order.

    Steps are re-ranking, the entity filter and the exact distance, as far as the options ask for them.
    """
    return reduce(lambda df, step: step(df), steps, registry.get(strategy, registry[default])())
