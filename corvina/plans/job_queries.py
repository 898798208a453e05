"""Queries of tagged tokens, patterns, registries, chunkers, approximate search and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvina.functions import text as X
from corvina.operators import bm25, chunking, entities, graph, jobs, ontology, search, triples
from corvina.plans.inputs import EDGES, STATEMENTS, edges, statements
from corvina.plans.registry import query, table
from corvina.plans.search_queries import _BM25, _index, _score, _text_queries, _vector_queries

# tokens of an order's lines: the flags make the form, the quantity decides the tag
_TAGGED = """flags as (select l_orderkey as id, l_linenumber as n, case when l_linenumber % 2 = 0 then l_returnflag else l_returnflag || l_linestatus || 'xx' end as form,
  case when l_quantity > 25 then 'NNP' when l_quantity > 15 then 'NNG' when l_quantity > 8 then 'VV' else 'JKS' end as tag from lineitem),
line as (select id, form, tag, row_number() over (partition by id order by n, form, tag) as n from flags)"""


def _tagged(spark, d):
    q = F.col("l_quantity")
    tag = F.when(q > 25, "NNP").when(q > 15, "NNG").when(q > 8, "VV").otherwise("JKS")
    token = F.struct(F.col("l_linenumber").alias("n"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise(F.concat("l_returnflag", "l_linestatus", F.lit("xx"))).alias("form"), tag.alias("tag"))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(token)).alias("tokens"))


@query("k02_tagged_tokens", f"with {_TAGGED} select id, coalesce(string_agg(form, ' ' order by n) filter (tag in ('NNP', 'NNG') and length(form) >= 4), '') as strict, coalesce(string_agg(form, ' ' order by n) filter (tag <> 'JKS'), '') as extended from line group by id")
def tagged_tokens(spark, d):
    t = F.col("tokens")
    return _tagged(spark, d).select("id", F.array_join(X.tagged_tokens(t, False, 4), " ").alias("strict"), F.array_join(X.tagged_tokens(t, True), " ").alias("extended"))


@query("k04_merge_proper_nouns", f"""with {_TAGGED}, g as (select *, sum(case when tag <> 'NNP' then 1 else 0 end) over (partition by id order by n) as g from line),
r as (select id, g, string_agg(form, '' order by n) as name, min(n) as n from g where tag = 'NNP' group by id, g), u as (select id, name, min(n) as n from r where length(name) >= 2 group by id, name)
select id, coalesce(names, '') as names from (select distinct id from line) left join (select id, string_agg(name, '|' order by n) as names from u group by id) using (id)""")
def merge_proper_nouns(spark, d):
    return _tagged(spark, d).select("id", F.array_join(X.merge_proper_nouns(F.col("tokens")), "|").alias("names"))


_PATTERNED = """s as (select s_suppkey as chunk_id, case s_suppkey % 5 when 0 then n_name || '은 ' || r_name || '이다' when 1 then n_name || '란 ' || r_name || ' 나라를 말한다' when 2 then n_name || '이 ' || r_name || '을 사랑한다'
  when 3 then n_name || '의 수도는 ' || r_name || '이다' else s_name end as text from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def _patterned(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k, n, r = F.col("s_suppkey") % 5, F.col("n_name"), F.col("r_name")
    text = F.when(k == 0, F.concat(n, F.lit("은 "), r, F.lit("이다"))).when(k == 1, F.concat(n, F.lit("란 "), r, F.lit(" 나라를 말한다"))).when(k == 2, F.concat(n, F.lit("이 "), r, F.lit("을 사랑한다")))
    return s.select(F.col("s_suppkey").alias("chunk_id"), text.when(k == 3, F.concat(n, F.lit("의 수도는 "), r, F.lit("이다"))).otherwise(F.col("s_name")).alias("text"))


def _pattern_rows() -> str:
    rules = [("class", p, "1", None, "2", 0.7) for p in triples.CLASS_PATTERNS] + [("relation", p, "1", "3", "2", 0.6) for p in triples.RELATION_PATTERNS] + [("property", p, "1", "2", "3", 0.6) for p in triples.PROPERTY_PATTERNS]
    parts = []
    for kind, pattern, s, p, o, confidence in rules:
        def part(k, pattern=pattern):
            return f"unnest(list_transform(regexp_extract_all(text, '{pattern}', {k}), lambda x: trim(x)))" if k else "null::varchar"

        whole = f"unnest(regexp_extract_all(text, '{pattern}', 0))"
        parts.append(f"select chunk_id, '{kind}' as kind, {part(s)} as subject, {part(p)} as predicate, {part(o)} as object, {confidence}::double as confidence, {whole} as source_text from s")
    return "c as (" + " union all ".join(parts) + ")"


@query("k09_candidate_patterns", f"with {_PATTERNED}, {_pattern_rows()} select * from c")
def candidate_patterns(spark, d):
    return triples.candidate_patterns(_patterned(spark, d)).drop("is_literal")


@query("t13_evidence_rows", rf"""with {_PATTERNED}, {_pattern_rows()}, u as (select *, case kind when 'property' then 'prop/' else 'rel/' end as space from c where kind <> 'class')
select 'urn:' || chunk_id as g, 'urn:onto:inst/' || trim(regexp_replace(subject, '[^\p{{L}}\p{{N}}]', '_', 'g'), '_') as s, 'urn:onto:' || space || trim(regexp_replace(predicate, '[^\p{{L}}\p{{N}}]', '_', 'g'), '_') as p,
case kind when 'property' then object else 'urn:onto:inst/' || trim(regexp_replace(object, '[^\p{{L}}\p{{N}}]', '_', 'g'), '_') end as o, confidence, source_text as evidence_text, 'chunk:' || chunk_id as source, md5(text) as chunk_hash, 'run1' as run_id from u join s using (chunk_id)""")
def evidence_rows(spark, d):
    chunks = _patterned(spark, d)
    found = triples.candidate_patterns(chunks).where("kind <> 'class'")
    key = F.col("chunk_id").cast("string")
    return triples.evidence_rows(found, chunks.select("chunk_id", F.concat(F.lit("urn:"), key).alias("graph"), F.concat(F.lit("chunk:"), key).alias("uri"), F.md5("text").alias("chunk_hash")), "run1")


@query("f09_score_history", "with a as (select l_suppkey as query_id, l_partkey as id, sum(l_quantity)::double as score from lineitem group by all), b as (select l_suppkey as query_id, l_partkey as id, max(l_discount)::double as score from lineitem where l_quantity > 25 group by all) select query_id, id, round(a.score, 6) as bm25, round(b.score, 6) as ann, (a.score is not null)::int + (b.score is not null)::int as stages from a full join b using (query_id, id)")
def score_history(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("id"), "l_quantity", "l_discount")
    a = rows.groupBy("query_id", "id").agg(F.sum("l_quantity").alias("score"))
    b = rows.where("l_quantity > 25").groupBy("query_id", "id").agg(F.max("l_discount").alias("score"))
    h = search.score_history({"bm25": a, "ann": b})
    return h.select("query_id", "id", F.round(F.try_element_at("history", F.lit("bm25")), 6).alias("bm25"), F.round(F.try_element_at("history", F.lit("ann")), 6).alias("ann"), F.size("history").alias("stages"))


@query("f10_legacy_search", f"with {_BM25} select query_id, id, round(score, 6) as score, rank from bm25 where rank <= 10 and score >= 1")
def legacy_search(spark, d):
    kinds = {
        "keyword": lambda: bm25.bm25_search(_index(spark, d), _text_queries(spark, d), 10),
        "vector": lambda: search.knn_exact(table(spark, d, "embeddings"), _vector_queries(spark, d), 10),
    }
    return search.legacy_search("keyword", kinds, [lambda df: df.where("score >= 1")]).select("query_id", "id", _score(), "rank")


_LOGS = "case event_type when 'view' then 'Entity search' when 'click' then 'No fallback search performed' when 'purchase' then 'Fallback search used' when 'signup' then 'Query generation FAILED' else 'Entity-guided query' end"


@query("f11_result_flags", f"with l as (select user_id, lower({_LOGS}) as x from events) select user_id, bool_or(contains(x, 'error') or contains(x, 'failed')) as has_error, bool_or((contains(x, 'fallback') or contains(x, 'entity-guided')) and not contains(x, 'no fallback') and not contains(x, 'fallback search disabled')) as used_fallback from l group by user_id")
def result_flags(spark, d):
    logs = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.expr(_LOGS)).alias("logs"))
    return logs.select("user_id", X.result_flags(F.col("logs")).alias("f")).select("user_id", "f.*")


_ASKED = """q as (select s_suppkey as query_id, s_name || case s_suppkey % 4 when 0 then '을' when 1 then '를' when 2 then '의' else ' ' end || ' 찾아줘' as query_text, s_name,
  case s_suppkey % 5 when 0 then 'object' when 1 then 'subject' end as role from supplier)"""


@query("g03_classify_pattern", f"with {_ASKED} select query_id, case when query_id % 7 = 0 then null when query_id % 3 = 0 then 'relation_unknown' when role = 'object' or (role is null and query_id % 4 in (0, 1)) then 'subject_unknown' else 'object_unknown' end as pattern from q")
def classify_pattern(spark, d):
    k = F.col("s_suppkey")
    tail = F.when(k % 4 == 0, "을").when(k % 4 == 1, "를").when(k % 4 == 2, "의").otherwise(" ")
    q = table(spark, d, "supplier").select(k.alias("query_id"), F.concat("s_name", tail, F.lit(" 찾아줘")).alias("query_text"), "s_name", F.when(k % 5 == 0, "object").when(k % 5 == 1, "subject").alias("role"))
    one = q.where("query_id % 7 <> 0").select("query_id", F.col("s_name").alias("name"), "role")
    both = one.unionByName(one.where("query_id % 3 = 0").withColumn("name", F.lit("other")))
    return graph.classify_pattern(q.select("query_id", "query_text"), both)


@query("g15_class_instances", "select c_name as instance, case when c_custkey % 2 = 0 then 'label of ' || c_name else string_split(c_name, '#')[-1] end as label from customer where c_mktsegment = 'BUILDING' order by c_name limit 100")
def class_instances(spark, d):
    c = table(spark, d, "customer")
    labels = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("uri"), F.concat(F.lit("label of "), "c_name").alias("label"))
    return ontology.class_instances(c.select(F.col("c_name").alias("s"), F.col("c_mktsegment").alias("type")), labels, "BUILDING")


@query("g20_graph_search", f"""with {EDGES}, q as (select n_nationkey as query_id, n_name as name, case n_nationkey % 3 when 0 then [] when 1 then ['located'] else ['nothing'] end::varchar[] as k from nation union all select 1000, 'nowhere', []),
h as (select name, subject, predicate, object, source_node_id from edges join q on name = subject union select name, subject, predicate, object, source_node_id from edges join q on name = object),
f as (select * from (select *, row_number() over (partition by name order by subject, predicate, object, source_node_id) as n from h) where n <= 30), t as (select query_id, k, subject, predicate, object, source_node_id from f join q using (name)),
ok as (select query_id from t group by query_id having bool_or(len(k) = 0 or contains(lower(predicate || ' ' || object), k[1]))), c as (select query_id, source_node_id, count(*) as n_triples from t semi join ok using (query_id) group by all)
select query_id, source_node_id, coalesce(n_triples, 0) as n_triples, case when n_triples is null then 0.0 else 1.0 end::double as score from q left join c using (query_id)""")
def graph_search(spark, d):
    k = F.col("n_nationkey") % 3
    words = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("located"))).otherwise(F.array(F.lit("nothing")))
    q = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_name").alias("name"), words.alias("keywords"))
    q = q.unionByName(spark.createDataFrame([(1000, "nowhere", [])], "query_id long, name string, keywords array<string>"))
    return graph.graph_search(edges(spark, d), q.select("query_id", "keywords"), q.select("query_id", "name"))


@query("g21_entity_guided_query", "select r_regionkey as query_id, 'where is ' || r_name || coalesce(' ' || names, '') as query_text from region left join (select n_regionkey as r_regionkey, string_agg(n_name, ' ' order by n_name) as names from nation where n_nationkey % 2 = 0 group by 1) using (r_regionkey)")
def entity_guided_query(spark, d):
    q = table(spark, d, "region").select(F.col("r_regionkey").alias("query_id"), F.concat(F.lit("where is "), "r_name").alias("query_text"))
    return graph.entity_guided_query(q, table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_regionkey").alias("query_id"), F.col("n_name").alias("name")))


_REGISTRY = "labels as (select 'u' || c_custkey as uri, c_name as label from customer), alias as (select c_name as label, c_name || ' of ' || n_name as alias from customer join nation on c_nationkey = n_nationkey where c_custkey % 3 = 0)"


@query("e15_registry_aliases", f"with {_REGISTRY} select uri, label from labels union select uri, alias from labels join alias using (label)")
def registry_aliases(spark, d):
    c = table(spark, d, "customer")
    labels = c.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("uri"), F.col("c_name").alias("label"))
    more = c.where("c_custkey % 3 = 0").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("label"), F.concat("c_name", F.lit(" of "), "n_name").alias("alias"))
    return entities.add_aliases(labels, more)


# customers 4k+1 to 4k+3 are merged into 4k, in a chain
@query("e15_registry_merge", "select 'u' || (c_custkey - c_custkey % 4) as uri, c_name as label from customer where c_custkey % 4 <> 0 and c_custkey > 4 union select 'u' || c_custkey, c_name from customer")
def registry_merge(spark, d):
    c = table(spark, d, "customer")
    labels = c.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("uri"), F.col("c_name").alias("label"))
    named = c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("label"))
    old = c.where("c_custkey % 4 <> 0 and c_custkey > 4").select((F.col("c_custkey") - 1).alias("k"), F.col("c_name").alias("old"))
    return entities.merge_entries(labels, named.join(old, "k").select("label", "old"))[0]


@query("e15_registry_synonyms", f"with {_REGISTRY} select uri, label from labels union select uri, label || '!' from labels where substr(uri, 2)::bigint % 2 = 0 union select 'urn:onto:class/' || n_name, n_name from nation union select 'urn:onto:class/' || n_name, n_name || '!' from nation")
def registry_synonyms(spark, d):
    c = table(spark, d, "customer")
    labels = c.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("uri"), F.col("c_name").alias("label"))
    told = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("label"), F.lit("instance").alias("type")).unionByName(table(spark, d, "nation").select(F.col("n_name").alias("label"), F.lit("class").alias("type")))
    return entities.load_synonyms(labels, told.withColumn("aliases", F.array(F.concat("label", F.lit("!")))))


@query("e17_resolve_mentions")
def resolve_mentions(spark, d):
    m = table(spark, d, "nation").select(F.col("n_regionkey").alias("query_id"), F.col("n_name").alias("token"))
    return graph.resolve_mentions(m, graph.nodes_of(edges(spark, d)))


@query("e02_ratio_without_library", "select c_custkey, case c_custkey % 3 when 0 then 1.0 when 1 then 0.8 else 0.0 end::double as ratio from customer")
def ratio_without_library(spark, d):
    k = F.col("c_custkey") % 3
    other = F.when(k == 0, F.upper("c_name")).when(k == 1, F.substring("c_name", 1, 8)).otherwise(F.lit("\u0000none"))
    return table(spark, d, "customer").select("c_custkey", X.ratio_without_library(F.col("c_name"), other).alias("ratio"))


def _sentences(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 50).alias("doc_id"), (F.col("vec_id") % 50).alias("pos"), F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("sentence"), F.col("embedding").cast("array<double>").alias("vec"))


@query("c08_semantic_chunks", """with s as (select vec_id // 50 as doc_id, vec_id % 50 as pos, 's' || vec_id as sentence, embedding::double[] as vec from embeddings),
g as (select *, 1 - list_cosine_similarity(vec, lead(vec) over (partition by doc_id order by pos)) as gap from s), b as (select doc_id, quantile_cont(gap, 0.95) as bound from g group by doc_id),
t as (select g.*, coalesce((lag(gap) over (partition by doc_id order by pos) > bound)::int, 0) as turn from g join b using (doc_id)), n as (select *, sum(turn) over (partition by doc_id order by pos) as chunk from t)
select doc_id, chunk::bigint as chunk, min(pos) as first, max(pos) as last, string_agg(sentence, ' ' order by pos) as content from n group by doc_id, chunk""")
def semantic_chunks(spark, d):
    return chunking.semantic_chunks(_sentences(spark, d)).withColumnRenamed("id", "doc_id")


@query("c15_locate_chunks", """with c as (select doc_id, 0 as n, 1 as at, substr(text, 1, 40) as content from documents where length(text) >= 200 union all select doc_id, 1, 101, substr(text, 101, 60) from documents where length(text) >= 200),
p as (select c.doc_id, n, content, instr(text, regexp_extract(content, '(?s)^\\s*(.*?)\\s*$', 1)) - 1 as start_offset from c join documents using (doc_id)) select doc_id, row_number() over (partition by doc_id order by start_offset, n) - 1 as chunk_index, start_offset, content from p""".replace("\\\\", "\\"))
def locate_chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    some = docs.where(F.length("text") >= 200)
    parts = some.select(F.col("doc_id").alias("id"), F.inline(F.array(F.struct(F.lit(0).alias("n"), F.substring("text", 1, 40).alias("content")), F.struct(F.lit(1).alias("n"), F.substring("text", 101, 60).alias("content")))))
    return chunking.locate_chunks(parts, docs).withColumnRenamed("id", "doc_id")


def _chunker(name, run, oracle=None):
    @query(name, oracle)
    def chunk(spark, d):
        return run(table(spark, d, "documents").select("doc_id", "text"))


def _windows_sql(size: int, overlap: int, end: str) -> str:
    """Windows of texts (t) from lo to hi; ``end`` tells from seg, the longest window, where it ends if the text goes on."""
    step = f"""select *, case when lo + length(seg) >= length(t) then length(t) else lo + ({end}) end as hi"""
    seg = f"substr(t, lo + 1, {size}) as seg"
    return f"""with recursive w as (
  {step} from (select doc_id, 0 as n, text as t, 0::bigint as lo, substr(text, 1, {size}) as seg from documents where text <> '')
  union all
  {step} from (select doc_id, n + 1 as n, t, greatest(hi - {overlap}, lo + 1) as lo, substr(t, greatest(hi - {overlap}, lo + 1)::bigint + 1, {size}) as seg from w where hi < length(t))
) select doc_id, n::int as chunk_index, lo::int as start_offset, hi::int as end_offset, substr(t, lo + 1, hi - lo) as content from w"""


def _last(mark: str, text: str = "seg") -> str:
    """Where a mark begins last, from 0; -1 where it doesn't occur."""
    return f"case when contains({text}, {mark}) then length({text}) - length({mark}) - instr(reverse({text}), reverse({mark})) + 1 else -1 end"


_OE_END = "greatest({})".format(", ".join(_last(m) for m in ("'. '", "'! '", "'? '", "'.' || chr(10)")))
_OE = _windows_sql(2_000, 500, f"case when {_OE_END} > 1000 then {_OE_END} + 1 else length(seg) end")
#: A mark counts among the last 500 characters of a window.
_SEGMENT_END = "case " + " ".join(f"when contains(right(seg, 500), {m}) then length(seg) - 500 + {_last(m, 'right(seg, 500)')} + length({m})" for m in ("chr(10) || chr(10)", "chr(10)", "'. '")) + " else length(seg) end"


#: Sentences by their places; a chunk takes what fits, the next one begins with the last sentences that overlap.
_RAG = """with recursive p as (select doc_id, text, string_split(regexp_replace(text, '([.!?다요]\\s+|\\n\\n+)', '\\1' || chr(1), 'g'), chr(1)) as l from documents where text <> ''),
o as (select doc_id, text, unnest(range(len(l))) as i, unnest(l) as part, l from p), q as (select doc_id, any_value(text) as t, list({'s': s, 'e': e} order by i) as x from (select *, list_sum(list_transform(l[1 : i], lambda y: length(y)))::bigint as before from o),
  lateral (select coalesce(before, 0) as s, coalesce(before, 0) + length(part) as e) where trim(part, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' group by doc_id),
w as (
  select doc_id, 0 as n, t, x, 1::bigint as f, greatest(1, len(list_filter(x, lambda y: y.e - x[1].s <= 500))) as e from q
  union all
  select doc_id, n + 1, t, x, g, greatest(e + 1, len(list_filter(x, lambda y: y.e - x[g].s <= 500))) from (
    select *, least(e + 1, f + len(list_filter(x[f : e], lambda y: x[e].e - y.s > 100))) as g from w where e < len(x))
) select doc_id, n::int as chunk_index, x[f].s::int as start_offset, x[e].e::int as end_offset, substr(t, x[f].s + 1, x[e].e - x[f].s) as content from w""".replace("\\\\", "\\")


_chunker("c01_chunk_by_size", chunking.chunk_by_size)
_chunker("c03_chunk_sections", chunking.chunk_sections)
_chunker("c04_chunk_children", lambda docs: chunking.chunk_parent_child(docs)[1])
_chunker("c05_chunk_fixed_tokens", chunking.chunk_fixed_tokens)
_chunker("c09_chunk_oe", chunking.chunk_oe, _OE)
_chunker("c10_chunk_rag", chunking.chunk_rag, _RAG)
_chunker("c12_pre_segment", chunking.pre_segment, _windows_sql(8_000, 1_000, _SEGMENT_END))
_chunker("c14_context_chunks", chunking.context_chunks)
_chunker("c18_chunk_oe_rag", chunking.chunk_oe_rag)


@query("v10_hashed_embedding", """with t as (select c_custkey as id, unnest(string_split(lower(c_name || ' ' || c_mktsegment), ' ')) as token from customer), p as (select id, ('0x' || substr(md5(token), 1, 8))::bigint % 256 as place, count(*) as n from t group by all)
select id, place::int as place, round(n / sqrt(sum(n * n) over (partition by id)), 6) as weight from p""")
def hashed_embedding(spark, d):
    text = F.split(F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")), " ")
    rows = search.hashed_embedding(table(spark, d, "customer"), text, "c_custkey")
    return rows.select("id", F.posexplode("embedding").alias("place", "w")).where("w > 0").select("id", "place", F.round("w", 6).alias("weight"))


@query("v04_knn_ivf")
def knn_ivf(spark, d):
    return search.knn_ivf(table(spark, d, "embeddings"), _vector_queries(spark, d), 10, 32, 8).select("query_id", "id", _score(), "rank")


@query("v05_knn_lsh")
def knn_lsh(spark, d):
    return search.knn_lsh(table(spark, d, "embeddings"), _vector_queries(spark, d), 10).select("query_id", "id", _score(), "rank")


def _replies(spark, d):
    reply = F.to_json(F.struct(F.array(F.struct(F.col("c_name").alias("subject"), F.lit("located_in").alias("predicate"), F.col("n_name").alias("object"), F.lit(0.9).alias("confidence"))).alias("triples")))
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("ord"), F.col("c_custkey").alias("doc_id"), reply.alias("reply"))


@query("j01_ingest_text")
def ingest_text(spark, d):
    rules = spark.createDataFrame([("in", "located_in", "part_of", "inside")], "rule string, p1 string, p2 string, inferred string")
    known = edges(spark, d).where("predicate <> 'located_in'").select(*jobs.KEYS, "doc_id")
    done = jobs.ingest_text(table(spark, d, "documents").select("doc_id", "text"), _replies(spark, d), known, rules)
    return ontology.promotion_report({"chunks": done.chunks, "vectors": done.vectors, "triples": done.triples, "edges": done.edges})


@query("j02_ingest_structured", """with c as (select c_custkey as k, case when c_custkey % 2 = 0 then 'kb' || c_custkey else 'c' || c_custkey end as id, c_name, c_mktsegment, case when (c_custkey // 2) % 2 = 0 then 'kb' || (c_custkey // 2) else 'c' || (c_custkey // 2) end as friend from customer),
f as (select id as subject, 'label' as predicate, c_name as object from c union select id, 'segment', c_mktsegment from c union select id, 'knows', friend from c union select id, '_type', 'Customer' from c), known as (select id as subject, 'label' as predicate, c_name as object from c where k % 2 = 0)
select subject, predicate, object from known union select * from f""")
def ingest_structured(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    name = F.concat(F.lit("c"), k.cast("string"))
    body = F.to_json(F.struct(name.alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("type"), F.col("c_mktsegment").alias("segment"), F.concat(F.lit("c"), F.floor(k / 2).cast("string")).alias("knows")))
    own = c.where("c_custkey % 2 = 0").select(F.concat(F.lit("kb"), k.cast("string")).alias("id"), F.col("c_name").alias("label"))
    known = own.select(F.col("id").alias("subject"), F.lit("label").alias("predicate"), F.col("label").alias("object"))
    return jobs.ingest_structured(c.select(k.alias("doc_id"), body.alias("body")), known, own)


@query("j03_build_ontology", f"""with {_PATTERNED}, {_pattern_rows()}, n as (select kind, case when kind = 'class' then subject else predicate end as name, case when kind <> 'class' then subject end as domain, case when kind = 'relation' then object end as range, case when kind = 'class' then object end as comment from c)
select name as s, 'type' as p, case kind when 'class' then 'Class' when 'relation' then 'ObjectProperty' else 'DatatypeProperty' end as o from n union select name, 'label', name from n union select name, 'domain', domain from n where domain is not null
union select name, 'range', range from n where range is not null union select name, 'comment', comment from n where comment is not null""")
def build_ontology(spark, d):
    return jobs.build_ontology(_patterned(spark, d).withColumnRenamed("chunk_id", "doc_id"), "run1").declarations


@query("j04_promote", f"""with {STATEMENTS}, e as (select s, p, o, count(*) as n, max(conf) as c from statements group by all), kept as (select * from e where c >= 0.97 and n >= 2), ty as (select s as x, 'Supplier' as t from kept union select o, 'Part' from kept),
all_t as (select x, t from ty union select x, 'Agent' from ty where t = 'Supplier' union select x, 'Thing' from ty)
select 'evidence' as step, count(*) as value from e union all select 'kept', count(*) from kept union all select 'left_out', (select count(*) from e) - (select count(*) from kept) union all select 'schema', 10 union all select 'types', count(*) from all_t union all select 'classes_used', count(distinct t) from all_t""")
def promote(spark, d):
    classes = spark.createDataFrame([("Supplier", "Agent"), ("Agent", "Thing"), ("Part", "Thing"), ("Thing", None)], "name string, parent string")
    properties = spark.createDataFrame([("supplies", "Supplier", "Part", [])], "name string, domain string, range string, source_relations array<string>")
    return jobs.promote(statements(spark, d), classes, properties, 0.97, 2).report


@query("j05_preview_then_confirm", f"""with {EDGES}, m as (select c_name as variant, c_mktsegment as canonical from customer where c_custkey % 2 = 0), f as (select distinct coalesce(a.canonical, subject) as subject, case predicate when 'located_in' then 'lives_in' else predicate end as predicate, coalesce(b.canonical, object) as object
from edges left join m a on a.variant = subject left join m b on b.variant = object where predicate <> 'part_of'), k as (select subject, predicate, object from edges where predicate = 'part_of') select * from k union select * from f""")
def preview_then_confirm(spark, d):
    e = edges(spark, d)
    # groups that a user has made instead of suggested ones
    own = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_name").alias("entity"), F.col("c_mktsegment").alias("canonical"))
    seen = jobs.Preview(e.where("predicate <> 'part_of'"), own, own, None)
    return jobs.confirm(seen, e.where("predicate = 'part_of'"), own, spark.createDataFrame([("located_in", "lives_in")], "name string, to string"))
