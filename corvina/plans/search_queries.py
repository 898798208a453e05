"""Keyword and vector search, fusion and re-ranking over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvina.functions import text as X
from corvina.functions import vector as V
from corvina.operators import bm25, search
from corvina.plans.registry import query, table
from corvina.session import saved

_TOKENS = r"list_filter(string_split_regex(lower({0}), '\s+'), lambda x: x <> '')"
_INDEX = f"""t as (select doc_id as id, {_TOKENS.format('text')} as t from documents), d as (select id, len(t) as dl from t), s as (select count(*) as n, avg(dl) as avgdl from d),
postings as (select id, term, count(*) as tf from (select id, unnest(t) as term from t) group by all),
raw as (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as raw from (select term, count(*) as df from postings group by term), s),
idf as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw)"""
_BM25 = f"""{_INDEX}, q as (select item_id as query_id, term, count(*) as qf from (select item_id, unnest({_TOKENS.format('text')}) as term from benchmark) group by all),
scores as (select query_id, id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from q join idf using (term) join postings using (term) join d using (id), s group by all having sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) > 0),
bm25 as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from scores)"""
_DOT = "list_inner_product({0}::double[], {1}::double[])"
_COS = "(list_inner_product({0}::double[], {1}::double[]) / nullif(sqrt(list_inner_product({0}::double[], {0}::double[])) * sqrt(list_inner_product({1}::double[], {1}::double[])), 0))"
#: The stated queries: every vector whose id is divisible by 20, numbered like the benchmark's texts.
_VQ = "vq as (select vec_id // 20 as query_id, embedding as query_vec from embeddings where vec_id % 20 = 0)"
_KNN = f"{_VQ}, knn as (select query_id, vec_id as id, {_COS.format('embedding', 'query_vec')} as score from embeddings, vq), ann as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from knn)"


def _index(spark, d):
    return bm25.build_inverted_index(table(spark, d, "documents"))


def _text_queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _vector_queries(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select((F.col("vec_id") / 20).cast("long").alias("query_id"), F.col("embedding").alias("query_vec"))


def _score(c="score"):
    return F.round(c, 6).alias(c)


@query("b01_inverted_index", f"with {_INDEX} select term, df, round(idf, 6) as idf, sum(tf) as tf from idf join postings using (term) group by all")
def inverted_index(spark, d):
    ix = _index(spark, d)
    w = bm25.term_weights(ix).select("term", F.round("idf", 6).alias("idf"))
    return ix.postings.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df")).join(w, "term")


@query("b02_bm25_search", f"with {_BM25} select query_id, id, round(score, 6) as score, rank from bm25 where rank <= 10")
def bm25_search(spark, d):
    return bm25.bm25_search(_index(spark, d), _text_queries(spark, d), 10).select("query_id", "id", _score(), "rank")


@query("b03_attach_keywords", f"with {_BM25}, k as (select item_id as query_id, array_to_string({_TOKENS.format('text')}, ' ') as keywords from benchmark) select query_id, id, keywords, 'whitespace' as tokenizer from bm25 join k using (query_id) where rank <= 3")
def attach_keywords(spark, d):
    q = _text_queries(spark, d)
    hits = bm25.attach_keywords(bm25.bm25_search(_index(spark, d), q, 3), q)
    return hits.select("query_id", "id", F.array_join("keywords", " ").alias("keywords"), "tokenizer")


@query("v01_vector_metrics", f"""select a.vec_id, round({_COS.format('a.embedding', 'b.embedding')}, 6) as cosine, round({_DOT.format('a.embedding', 'b.embedding')}, 6) as inner_product,
round(list_distance(a.embedding::double[], b.embedding::double[]), 6) as l2 from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def vector_metrics(spark, d):
    a = _vectors(spark, d)
    b = a.select((F.col("id") - 1).alias("id"), F.col("vector").alias("w"))
    v, w = F.col("vector"), F.col("w")
    return a.join(b, "id").select(F.col("id").alias("vec_id"), F.round(V.cosine(v, w), 6).alias("cosine"), F.round(V.inner(v, w), 6).alias("inner_product"), F.round(V.l2(v, w), 6).alias("l2"))


@query("v02_score_from_metric", "select event_id, round(case when event_type = 'view' then 1 / (1 + value) else value end, 6) as score from events")
def score_from_metric(spark, d):
    metric = F.when(F.col("event_type") == "view", "L2").otherwise("COSINE")
    return table(spark, d, "events").select("event_id", F.round(V.score_from_metric(F.col("value"), metric), 6).alias("score"))


@query("v03_knn_exact", f"with {_KNN} select query_id, id, round(score, 6) as score, rank from ann where score >= 0.1 and rank <= 10")
def knn_exact(spark, d):
    return search.knn_exact(table(spark, d, "embeddings"), _vector_queries(spark, d), 10, "COSINE", 0.1).select("query_id", "id", _score(), "rank")


@query("v06_rescore_candidates", f"""with {_KNN}, r as (select query_id, id, score from ann where rank <= 50 and score >= 0.05)
select query_id, id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from r) where rank <= 10""")
def rescore_candidates(spark, d):
    q = _vector_queries(spark, d)
    seen = search.knn_exact(table(spark, d, "embeddings"), q, 50).select("query_id", "id", F.lit(1.0).alias("score"))
    return search.rescore_candidates(seen, _vectors(spark, d), q, 10, threshold=0.05).select("query_id", "id", _score(), "rank")


@query("v07_brute_force_l2", f"""with {_KNN}, c as (select query_id, id, list_distance(embedding::double[], query_vec::double[]) as l2_score from ann join vq using (query_id) join embeddings on vec_id = id where rank <= 50),
r as (select *, 1 / (1 + l2_score) as score from c where l2_score <= 1.4) select query_id, id, round(l2_score, 6) as l2_score, round(score, 6) as score, rank
from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from r) where rank <= 10""")
def brute_force_l2(spark, d):
    q = _vector_queries(spark, d)
    seen = search.knn_exact(table(spark, d, "embeddings"), q, 50).select("query_id", "id")
    return search.brute_force_l2(seen, _vectors(spark, d), q, 10, 1.4).select("query_id", "id", F.round("l2_score", 6).alias("l2_score"), _score(), "rank")


@query("v08_fetch_chunks", f"with {_BM25}, w as (select query_id, id, row_number() over (partition by query_id order by id) as n from bm25 where rank <= 5) select query_id, id, source, n_chars from w join documents on doc_id = id where n <= 3")
def fetch_chunks(spark, d):
    hits = bm25.bm25_search(_index(spark, d), _text_queries(spark, d), 5).select("query_id", "id")
    return search.fetch_chunks(hits, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars"), 3)


@query("v09_graph_boost", f"with {_KNN} select query_id, id, round(least(score * 1.5, 1.0), 6) as score, round(score, 6) as original_score from ann where rank <= 10")
def graph_boost(spark, d):
    hits = search.knn_exact(table(spark, d, "embeddings"), _vector_queries(spark, d), 10)
    return search.graph_boost(hits).select("query_id", "id", _score(), _score("original_score"))


_BOTH = f"{_BM25}, {_KNN}"


def _pair(spark, d, k=30):
    """The same ids have a BM25 and a cosine score; query i asks with text i and vector i."""
    text = bm25.bm25_search(_index(spark, d), _text_queries(spark, d), k)
    return text, search.knn_exact(table(spark, d, "embeddings"), _vector_queries(spark, d), k)


@query("f01_rrf_fuse", f"""with {_BOTH}, l as (select query_id, id, rank from bm25 where rank <= 30 union all select query_id, id, rank from ann where rank <= 30),
f as (select query_id, id, sum(1.0::double / (60 + rank)) as score from l group by all) select query_id, id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from f) where rank <= 10""")
def rrf_fuse(spark, d):
    return search.rrf_fuse(list(_pair(spark, d)), top=10).select("query_id", "id", _score(), "rank")


@query("f02_hybrid_sequential", f"""with {_BOTH}, g as (select query_id, id from ann where rank <= 5), b as (select query_id, id, rank as bm25_rank from bm25 where rank <= 30),
c as (select query_id, id, bm25_rank, g.id is not null as graph from b full join g using (query_id, id)), r as (select c.*, score as cosine, row_number() over (partition by query_id order by round(score, 9) desc, id) as ann_rank from c join knn using (query_id, id)),
f as (select query_id, id, 1.0::double / (60 + coalesce(bm25_rank, 9999)) + 1.0::double / (60 + ann_rank) + case when graph then 0.001 else 0 end as score from r)
select query_id, id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from f) where rank <= 10""")
def hybrid_sequential(spark, d):
    text, near = _pair(spark, d)
    return search.hybrid_sequential(text, _vectors(spark, d), _vector_queries(spark, d), 10, 30, near.where("rank <= 5")).select("query_id", "id", _score(), "rank")


_MERGE = f"""with {_BOTH}, a as (select query_id, id, score from bm25 where rank <= 30), b as (select query_id, id, score from ann where rank <= 200)
select query_id, id, round(coalesce(b.score, a.score), 6) as score, round(a.score, 6) as was, round(b.score, 6) as now from a {{0}} join b using (query_id, id)"""


def _merge(spark, d, mode):
    text, near = _pair(spark, d, 200)
    text = text.where("rank <= 30").withColumn("history", F.create_map(F.lit("BM25"), "score"))
    m = search.merge_results(text, near, "ANN", mode)
    return m.select("query_id", "id", _score(), F.round(F.try_element_at("history", F.lit("BM25")), 6).alias("was"), F.round(F.try_element_at("history", F.lit("ANN")), 6).alias("now"))


@query("f03_merge_union", _MERGE.format("full"))
def merge_union(spark, d):
    return _merge(spark, d, "union")


@query("f03_merge_intersection", _MERGE.format("inner"))
def merge_intersection(spark, d):
    return _merge(spark, d, "intersection")


@query("f04_run_pipeline", f"""with {_BM25}, e as (select query_id, id, least(score * 1.5, 1.0) as score from bm25 where rank <= 30) select query_id, id, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from e""")
def run_pipeline(spark, d):
    start = bm25.bm25_search(_index(spark, d), _text_queries(spark, d), 30)
    stages = [("graph", {"factor": 1.5}), ("unknown", {})]
    return search.run_pipeline(stages, start, {"graph": search.graph_boost}).select("query_id", "id", _score(), "rank")


_OVERLAP = f"""ov as (select query_id, id, score, len(list_intersect(qt, dt)) / greatest(len(list_distinct(qt)), 1)::double as raw from (select b.query_id, b.id, b.score, {_TOKENS.format('q.text')} as qt, t.t as dt from bm25 b join benchmark q on q.item_id = b.query_id join t on t.id = b.id where b.rank <= 20))"""


def _overlap(spark, d):
    q = _text_queries(spark, d)
    hits = saved(bm25.bm25_search(_index(spark, d), q, 20), "hits")
    full = hits.join(q, "query_id").join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return full.select("query_id", "id", "score", search.token_overlap(X.tokens(F.col("query_text")), X.tokens(F.col("text"))).alias("raw"))


@query("f05_two_stage", f"with {_BM25}, {_OVERLAP} select query_id, id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by round(raw, 9) desc, id) as rank from ov where score >= 1) where rank <= 5")
def two_stage(spark, d):
    return search.two_stage(_overlap(spark, d), "raw", 5, 1.0).select("query_id", "id", _score(), "rank")


@query("f06_rerank", f"""with {_BM25}, {_OVERLAP}, m as (select *, min(raw) over (partition by query_id) as lo, max(raw) over (partition by query_id) as hi from ov),
r as (select query_id, id, greatest(0.01, case when hi = lo then 0.5 else (raw - lo) / (hi - lo) end) as s from m)
select query_id, id, round(s, 6) as rerank_score, rank from (select *, row_number() over (partition by query_id order by round(s, 9) desc, id) as rank from r where s >= 0.2) where rank <= 10""")
def rerank(spark, d):
    return search.rerank(_overlap(spark, d), "raw", 10, 0.2).select("query_id", "id", _score("rerank_score"), "rank")


@query("f07_parse_scores", r"select event_id, round(least(greatest(coalesce(try_cast(regexp_extract(x, '(\d+\.?\d*)', 1) as double), 0), 0), 1), 6) as score from (select event_id, case when event_id % 3 = 0 then 'score: ' || round(value / 300, 2) || ' of 1' when event_id % 3 = 1 then 'none' else '7 apples' end as x from events)")
def parse_scores(spark, d):
    k = F.col("event_id") % 3
    # rounded as doubles, as SQL does: 0.285 is a little less than its decimal form says
    hundreds = F.abs(F.col("value") / 300 * 100)
    whole = F.floor(hundreds)
    share = F.signum("value") * (whole + F.when(hundreds - whole >= 0.5, 1).otherwise(0)) / 100
    x = F.when(k == 0, F.concat(F.lit("score: "), share.cast("string"), F.lit(" of 1"))).when(k == 1, "none").otherwise("7 apples")
    return table(spark, d, "events").select("event_id", F.round(X.first_number(x), 6).alias("score"))


@query("f08_entity_filter", f"""with {_BM25}, flagged as (select query_id, id, score, case when query_id % 3 = 0 then false else lang <> 'en' end as miss from bm25 join documents on doc_id = id where rank <= 20),
scored as (select query_id, id, case when miss then score * 0.3 else score end as score, score as original_score from flagged) select query_id, id, round(score, 6) as score, round(original_score, 6) as original_score, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from scored""")
def entity_filter(spark, d):
    hits = bm25.bm25_search(_index(spark, d), _text_queries(spark, d), 20).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array("lang").alias("ce")), "id")
    asked = F.when(F.col("query_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("en")))
    return search.entity_filter(hits.withColumn("qe", asked), "qe", "ce").select("query_id", "id", _score(), _score("original_score"), "rank")
