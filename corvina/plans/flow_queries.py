"""Whole flows: ingestion with names merged, previews that are confirmed, alignment, listings, streams, resumed stages, injected functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvina.functions import text as X
from corvina.operators import bm25, graph, injected, jobs, ontology, retrieval, search
from corvina.plans.inputs import EDGES, STATUS_EVENTS, edges, status_events
from corvina.plans.registry import query, table
from corvina.plans.triple_queries import alike_sql
from corvina.session import fresh_path
from corvina.sources import tables
from corvina.streaming import status


def _groups_sql(pairs: str) -> str:
    """groups(entity, canonical) of pairs(a, b): labels go along pairs until none gets smaller."""
    return f"""both_ways as (select a, b from {pairs} union all select b, a from {pairs}),
cc(node, label) using key (node) as (
  select distinct a as node, a as label from both_ways
  union
  (select b as node, min(cc.label) as label from cc join both_ways on cc.node = a join recurring.cc as old on old.node = b where cc.label < old.label group by b)
), heads as (select label, arg_min(node, (-length(node), node)) as canonical from cc group by label),
groups as (select node as entity, canonical from cc join heads using (label))"""


# j01: customers by their segments live in regions; a dictionary knows segments by other names


_REPLY_NAMES = """told as (select c_custkey as ord, case c_mktsegment when 'MACHINERY' then 'Machines' else c_mktsegment end || ' ' || c_name as subject, r_name as object
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
known as (select n_name as subject, 'part_of' as predicate, r_name as object from nation join region on n_regionkey = r_regionkey)"""


def _ingested(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    segment = F.when(F.col("c_mktsegment") == "MACHINERY", "Machines").otherwise(F.col("c_mktsegment"))
    name = F.concat_ws(" ", segment, "c_name")
    triple = F.struct(F.concat_ws(" ", "c_mktsegment", "c_name").alias("subject"), F.lit("lives_in").alias("predicate"), F.col("r_name").alias("object"), F.lit(0.9).alias("confidence"))
    replies = c.select(F.col("c_custkey").alias("ord"), F.col("c_custkey").alias("doc_id"), F.to_json(F.struct(F.array(triple).alias("triples"))).alias("reply"))
    mentions = c.select(F.concat_ws(" ", "c_mktsegment", "c_name").alias("name"), F.lit("Customer").alias("type"), F.lit("crm").alias("source")).union(c.select("r_name", F.lit("Region"), F.lit("crm")))
    lines = c.where("c_mktsegment = 'MACHINERY'").select(F.lit(1).alias("batch"), F.concat_ws(", ", name, F.concat_ws(" ", "c_mktsegment", "c_name")).alias("line"))
    known = edges(spark, d).where("predicate = 'part_of'").select(*jobs.KEYS, "doc_id")
    return jobs.ingest_text(table(spark, d, "documents").select("doc_id", "text"), replies, known, mentions=mentions, lines=lines)


@query("j01_ingested_edges", f"with recursive {_REPLY_NAMES}, near as (select distinct subject as x from told union select distinct object from told), pairs as ({{}}), {_groups_sql('pairs')} select * from known union select distinct coalesce(canonical, subject), 'lives_in', object from told left join groups on entity = subject".replace("{}", "with " + alike_sql(0.85)))
def ingested_edges(spark, d):
    return _ingested(spark, d).edges.select(*jobs.KEYS)


@query("j01_dictionary", f"with {_REPLY_NAMES} select subject as canonical, 'Customer' as type, case when subject like 'Machines %' then subject || '|' else '' end || replace(subject, 'Machines ', 'MACHINERY ') as variants from told union all select distinct object, 'Region', object from told".replace("subject || '|' else '' end || replace(subject, 'Machines ', 'MACHINERY ')", "replace(subject, 'Machines ', 'MACHINERY ') else subject end"))
def ingested_dictionary(spark, d):
    return _ingested(spark, d).dictionary.select("canonical", "type", F.array_join("variants", "|").alias("variants"))


@query("j01_stored_chunks")
def stored_chunks(spark, d):
    root = fresh_path(spark, "ingested")
    jobs.store(_ingested(spark, d), root, "kb1")
    return spark.read.parquet(f"{root}/chunks").select("kb_id", "chunk_id", "doc_id", "start_offset", "content")


# j05: the suggestions of a preview that touch enough triples are chosen

_LISTED = """found as (select p_partkey as ord, p_brand || ' ' || p_type || ' ' || (p_size // 10) as subject, 'listed_as' as predicate, p_name as object from part),
near as (select distinct subject as x from found union select distinct object from found)"""


def _previewed(spark, d):
    p = table(spark, d, "part")
    name = F.concat_ws(" ", "p_brand", "p_type", F.floor(F.col("p_size") / 10).cast("string"))
    return jobs.preview(p.select(F.col("p_partkey").alias("ord"), name.alias("subject"), F.lit("listed_as").alias("predicate"), F.col("p_name").alias("object")), 0.93)


_J05 = f"with recursive {_LISTED}, pairs as (with {alike_sql(0.93)}), {_groups_sql('pairs')}, ends as (select ord, unnest([subject, object]) as entity from found), touched as (select canonical, count(distinct ord) as n_triples from ends join groups using (entity) group by canonical)"


@query("j05_preview_suggestions", f"{_J05} select canonical, n_triples, string_agg(entity, '|' order by entity) as variants from groups join touched using (canonical) where entity <> canonical group by all")
def preview_suggestions(spark, d):
    return _previewed(spark, d).suggestions.select("canonical", "n_triples", F.array_join("variants", "|").alias("variants"))


@query("j05_confirm_chosen", f"""{_J05}, chosen as (select entity as variant, canonical from groups join touched using (canonical) where n_triples >= 4 and entity <> canonical)
select n_name as subject, 'part_of' as predicate, r_name as object from nation join region on n_regionkey = r_regionkey union select distinct coalesce(a.canonical, subject), 'sold_as', coalesce(b.canonical, object) from found left join chosen a on a.variant = subject left join chosen b on b.variant = object""")
def confirm_chosen(spark, d):
    seen = _previewed(spark, d)
    chosen = seen.suggestions.where("n_triples >= 4")
    return jobs.confirm(seen, edges(spark, d).where("predicate = 'part_of'"), chosen, spark.createDataFrame([("listed_as", "sold_as")], "name string, to string"))


# o17: part names with a letter added, cut or in another case against some declared names


def _aligned(spark, d):
    p = table(spark, d, "part")
    changed = F.when(F.col("p_partkey") % 4 == 0, F.upper("p_name")).when(F.col("p_partkey") % 4 == 1, F.concat("p_name", F.lit("s"))).when(F.col("p_partkey") % 4 == 2, F.expr("substring(p_name, 2)")).otherwise(F.reverse("p_name"))
    wanted = p.select(F.lit("class").alias("kind"), changed.alias("name")).union(p.select(F.lit("property"), F.concat(F.lit("has "), "p_type"))).distinct()
    declared = p.where("p_size % 3 = 0").select(F.lit("class").alias("kind"), F.col("p_name").alias("name")).distinct()
    return wanted, declared


@query("o17_align_similar")
def align_similar(spark, d):
    return ontology.align(*_aligned(spark, d))


@query("o17_alignment_flags", "select false as existing_empty, false as disjoint, true as has_mismatch")
def alignment_flags(spark, d):
    wanted, declared = _aligned(spark, d)
    return ontology.alignment_flags(ontology.align(wanted, declared), declared)


@query("g16_page_with_texts", f"""with {EDGES}, c as (select 'd' || (doc_id % 50) || '_' || (doc_id % 7) as source_node_id, arg_min(text, doc_id) as content from documents group by 1), f as (select distinct 'd' || (doc_id % 50) as doc_id, 'file' || (doc_id % 50) || '.txt' as filename from documents)
select place, subject, predicate, object, confidence, filename, md5(coalesce(substr(content, 1, 500), '')) as chunk_text from (select *, row_number() over (order by predicate desc, confidence, subject, object, ord) - 1 as place from edges where contains(lower(object), '1'))
left join f using (doc_id) left join c using (source_node_id) where place >= 700 and place < 800""")
def page_with_texts(spark, d):
    docs = table(spark, d, "documents")
    doc = F.concat(F.lit("d"), (F.col("doc_id") % 50).cast("string"))
    node = F.concat_ws("_", doc, (F.col("doc_id") % 7).cast("string"))
    chunks = docs.groupBy(node.alias("chunk_id")).agg(F.min_by("text", "doc_id").alias("content"))
    files = docs.select(doc.alias("doc_id"), F.concat(F.lit("file"), (F.col("doc_id") % 50).cast("string"), F.lit(".txt")).alias("filename")).distinct()
    page, _ = graph.list_triples(edges(spark, d), object="1", skip=700, limit=100, sort=[("predicate", "desc"), ("confidence", "asc")], docs=files, chunks=chunks)
    return page.select(F.col("place").cast("long"), "subject", "predicate", "object", "confidence", "filename", F.md5(F.coalesce("chunk_text", F.lit(""))).alias("chunk_text"))


@query("g16_total", f"with {EDGES} select count(*) as total from edges where contains(lower(subject), 'order') and contains(lower(predicate), 'placed')")
def listing_total(spark, d):
    return graph.list_triples(edges(spark, d), subject="Order", predicate="PLACED")[1]


@query("g17_schema_lists", f"""with {EDGES}, e as (select subject, 'http://kg/rel/' || predicate as predicate, object, false as lit, 'Thing' as st, case predicate when 'part_of' then 'Region' end as ot from edges
 union all select c_name, 'type', 'urn:kg/class/' || c_mktsegment, false, null, null from customer union all select c_name, 'http://rag.local/meta/docId', c_mktsegment, true, null, null from customer union all select p_name, 'x#size', p_size::varchar, true, 'Part', null from part),
n as (select 'predicate' as kind, case when contains(predicate, '/rel/') then 'rel:' || string_split(predicate, '/rel/')[-1] else string_split(predicate, '#')[-1] end as name from e where not contains(predicate, 'rag.local/meta')
 union all select 'class', 'class:' || string_split(object, '/class/')[-1] from e where predicate = 'type' union all select 'relation', upper(regexp_replace(predicate, '[^a-zA-Z0-9_]', '_', 'g')) from e where predicate <> 'type' and not lit and not contains(predicate, 'rag.local/meta')
 union all select 'label', coalesce(st, 'Entity') from e where predicate <> 'type' union all select 'label', coalesce(ot, 'Entity') from e where predicate <> 'type' and not lit), c as (select kind, name, count(*) as n from n group by all)
select kind, name, n, row_number() over (partition by kind order by n desc, name) as rank from c""")
def schema_lists(spark, d):
    e = edges(spark, d).select("subject", F.concat(F.lit("http://kg/rel/"), "predicate").alias("predicate"), "object", F.lit(False).alias("is_literal"), F.lit("Thing").alias("subject_type"), F.when(F.col("predicate") == "part_of", "Region").alias("object_type"))
    c, nothing = table(spark, d, "customer"), F.lit(None).cast("string")
    e = e.union(c.select("c_name", F.lit("type"), F.concat(F.lit("urn:kg/class/"), "c_mktsegment"), F.lit(False), nothing, nothing))
    e = e.union(c.select("c_name", F.lit("http://rag.local/meta/docId"), "c_mktsegment", F.lit(True), nothing, nothing))
    e = e.union(table(spark, d, "part").select("p_name", F.lit("x#size"), F.col("p_size").cast("string"), F.lit(True), F.lit("Part"), nothing))
    return graph.live_schema(e).withColumn("rank", F.col("rank").cast("long"))


# streams


_SPELLS = f"""with {STATUS_EVENTS}, n as (select max(ts) - interval 5 minutes as now from status_events), s as (select *, lead(ts) over (partition by doc_id order by ts, event_id) as after from status_events, n where ts <= now)
select doc_id, status, ts from s where status in ('processing', 'deleting') and coalesce(after, now) - ts > case status when 'processing' then interval 10 minutes else interval 5 minutes end"""


@query("st2_stale_spells", _SPELLS)
def stale_spells(spark, d):
    e = status_events(spark, d)
    now = e.agg(F.max("ts") - F.expr("interval 5 minutes")).first()[0]
    return status.stale_spells(e, now)


@query("st2_stale_stream", _SPELLS)
def stale_stream(spark, d):
    at = fresh_path(spark, "stale")
    kind = F.col("event_type")
    told = F.when(kind == "signup", "pending").when(kind == "view", "processing").when(kind == "click", "deleting").when(kind == "purchase", "completed").otherwise("error")
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    rows = source.select("event_id", F.col("user_id").alias("doc_id"), "ts", told.alias("status"))
    sink = status.stale_stream(rows).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    sink.start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("st3_ingested_postings", r"""select count(distinct doc_id) as docs from documents where text is not null and regexp_matches(text, '\S')""")
def ingested_postings(spark, d):
    at = fresh_path(spark, "ingest")
    docs = table(spark, d, "documents")
    source = spark.readStream.schema(docs.schema).parquet(f"{d}/documents.parquet*")
    status.ingest_stream(source, f"{at}/out", f"{at}/state").awaitTermination()
    return status.read_ingested(spark, f"{at}/out").agg(F.countDistinct("doc_id").alias("docs"))


# sources


@query("s02_structured_yaml", "select c_custkey, c_name as name, c_mktsegment as segment, c_acctbal as balance, 2 as n, c_mktsegment || '!' as tag from customer")
def structured_yaml(spark, d):
    text = F.concat(
        F.lit("# a record\nname: '"), "c_name", F.lit("'\nprofile:\n  segment: "), "c_mktsegment", F.lit("  # of the market\n  balance: "), F.col("c_acctbal").cast("string"),
        F.lit("\ntags:\n- "), "c_mktsegment", F.lit('\n- "'), "c_mktsegment", F.lit('!"\nnote: |\n  two\n  lines\n'),
    )
    as_json = F.to_json(F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")).alias("profile"), F.array("c_mktsegment", F.concat("c_mktsegment", F.lit("!"))).alias("tags")))
    c = table(spark, d, "customer")
    kind = F.when(F.col("c_custkey") % 2 == 0, "yaml").otherwise("json")
    rows = c.select("c_custkey", F.when(kind == "yaml", text).otherwise(as_json).alias("text"), kind.alias("kind")).select("c_custkey", tables.structured_body(F.col("text"), F.col("kind")).alias("b"))

    def get(path, as_type):
        return F.variant_get("b", path, as_type)

    return rows.select("c_custkey", get("$.name", "string").alias("name"), get("$.profile.segment", "string").alias("segment"), get("$.profile.balance", "double").alias("balance"), F.size(get("$.tags", "array<string>")).alias("n"), get("$.tags[1]", "string").alias("tag"))


@query("s10_resumed_stages", f"with {EDGES} select doc_id, subject, upper(object) as object, 'b' as last_run from edges where predicate = 'located_in'")
def resumed_stages(spark, d):
    root = fresh_path(spark, "stages")
    e = edges(spark, d).where("predicate = 'located_in'").select("doc_id", "subject", "object")
    stages = [("named", lambda df: df.withColumn("object", F.lower("object"))), ("told", lambda df: df.withColumn("object", F.upper("object")))]
    some = e.where("doc_id < 'd3'")
    tables.resume_stages(some, root, "kb1", stages[:1], "a")
    told, _ = tables.resume_stages(e, root, "kb1", stages, "b")
    return told.select("doc_id", "subject", "object", F.lit("b").alias("last_run"))


# injected functions


@query("k02_injected_analyser", r"select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') as forms from part")
def injected_analyser(spark, d):
    def analyse(texts):
        return [[(w.capitalize(), "NNG") for w in t.split(" ")] + [("!", "SF")] for t in texts]

    rows = injected.analyse(table(spark, d, "part").select("p_partkey", "p_name"), analyse, "p_name")
    return rows.select("p_partkey", F.array_join(X.tagged_tokens(F.col("analysed")), " ").alias("forms"))


@query("u04_injected_extractor", "select l_orderkey || '_' || l_linenumber as chunk_id, 's' || l_suppkey as subject, 'ships' as predicate, 'p' || l_partkey as object, 0.8::double as confidence, null as error from lineitem where l_quantity <> 13 union all select l_orderkey || '_' || l_linenumber, null, null, null, null, 'ValueError: unlucky' from lineitem where l_quantity = 13")
def injected_extractor(spark, d):
    def extract(texts):
        if any(t.endswith(" 13") for t in texts):
            raise ValueError("unlucky")
        return [[{"subject": "s" + t.split(" ")[0], "predicate": "ships", "object": "p" + t.split(" ")[1]}, {"subject": "lost", "predicate": None, "object": "x"}] for t in texts]

    line = table(spark, d, "lineitem")
    content = F.concat_ws(" ", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string"))
    chunks = line.select(F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("chunk_id"), content.alias("content"))
    found, failed = injected.extract_triples(chunks, extract)
    return found.drop("pos").withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)


@query("v10_injected_embedder", "select c_custkey as id, round(length(c_name)::double, 6) as a, round(c_custkey::double / 7, 6) as b, null::varchar as error from customer")
def injected_embedder(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.concat_ws(" ", F.col("c_custkey").cast("string"), "c_name").alias("text"))

    def vectors(texts):
        return [[float(len(t.split(" ")[1])), int(t.split(" ")[0]) / 7] for t in texts]

    done = search.embed(rows, vectors, "c_custkey", "text")
    return done.select("id", F.round(F.col("embedding")[0], 6).alias("a"), F.round(F.col("embedding")[1], 6).alias("b"), "error")


@query("f06_injected_scorer", """with r as (select l_suppkey as query_id, l_partkey as id, max(l_quantity) as score from lineitem group by all), s as (select query_id, id, (query_id * 31 + id * 17) % 101 / 100.0::double as raw from r),
m as (select *, min(raw) over (partition by query_id) as lo, max(raw) over (partition by query_id) as hi from s), z as (select query_id, id, round(greatest(0.01, case when hi = lo then 0.5 else (raw - lo) / (hi - lo) end), 9) as score from m)
select query_id, id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from z) where rank <= 5""")
def injected_scorer(spark, d):
    hits = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("id")).agg(F.max("l_quantity").alias("score"))
    texts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("content"))
    queries = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), F.col("s_suppkey").cast("string").alias("query_text"))

    def score(asked, contents):
        return [(int(q) * 31 + int(c) * 17) % 101 / 100 for q, c in zip(asked, contents, strict=True)]

    best = search.rerank_injected(hits, texts, queries, score, 5)
    return best.select("query_id", "id", F.round("rerank_score", 6).alias("score"), F.col("rank").cast("long"))


# retrieval: documents are chunks, their vectors those of embeddings (by id, repeated), and queries benchmark texts


def _kb(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    chunks = docs.join(e, "id")
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text")).join(e.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vec")), "query_id")
    return chunks, queries


_KB = r"""chunks as (select doc_id as id, text as content, embedding::double[] as v from documents join embeddings on vec_id = doc_id), qs as (select item_id as query_id, text as query_text, embedding::double[] as qv from benchmark join embeddings on vec_id = item_id),
sims as (select query_id, id, list_cosine_similarity(qv, v) as score from qs join chunks on true), ct as (select id, list_filter(string_split_regex(lower(content), '[\s]+'), lambda w: w <> '') as t from chunks)"""


@query("f10_vector_then_l2", f"""with {_KB}, near as (select * from sims qualify row_number() over (partition by query_id order by round(score, 9) desc, id) <= 10), z as (select query_id, id, list_distance(v, qv) as dist from near join chunks using (id) join qs using (query_id))
select query_id, id, round(1 / (1 + dist), 6) as score, row_number() over (partition by query_id order by round(1 / (1 + dist), 9) desc, id) as rank from z where dist <= 1.2""")
def vector_then_l2(spark, d):
    chunks, queries = _kb(spark, d)
    out = retrieval.retrieve("vector", retrieval.Tables(chunks), queries, retrieval.Options(k=10, l2_distance=1.2))
    return out.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


_G20 = f"""with {EDGES}, c as (select 'd' || (vec_id % 50) || '_' || (vec_id % 7) as id, arg_min(embedding, vec_id)::double[] as v from embeddings group by 1),
q as (select n_nationkey::bigint as query_id, n_name, r_name, n_nationkey % 2 = 0 as two, embedding::double[] as qv, case n_nationkey % 3 when 0 then '' when 1 then 'part' else 'nothing' end as word from nation join region on n_regionkey = r_regionkey join embeddings on vec_id = n_nationkey),
nodes as (select distinct unnest([subject, object]) as node from edges), near as (select distinct name, node from (select n_name as name from q union select r_name from q) join nodes on length(node) > 1 and (contains(lower(node), lower(name)) or contains(lower(name), lower(node)))),
onelim as (select query_id, subject, predicate, object from (select distinct query_id, subject, predicate, object from edges join near on node = subject or node = object join q on n_name = name and not two) qualify row_number() over (partition by query_id order by subject, predicate, object) <= 100),
both_ as (select distinct query_id, subject, predicate, object from q join near a on a.name = n_name join near b on b.name = r_name join edges on (subject = a.node and object = b.node) or (subject = b.node and object = a.node) where two),
t as (select * from onelim union select * from both_), ok as (select query_id from t join q using (query_id) group by query_id having bool_or(word = '' or contains(lower(predicate || ' ' || object), word))), g as (select * from t semi join ok using (query_id)),
w as (select distinct query_id, source_node_id as id from g join edges using (subject, predicate, object)), few as (select * from w qualify row_number() over (partition by query_id order by id) <= 100),
s as (select query_id, id, list_cosine_similarity(v, qv) as original from few join c using (id) join q using (query_id)), b as (select query_id, id, original, least(original * 1.5, 1.0) as score from s),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from b), n as (select query_id, count(*) as n_triples from g group by 1), names as (select query_id, n_name as name from q union all select query_id, r_name from q where two),
k as (select query_id, string_agg(name, '|' order by name) as clickable from names semi join (select query_id, unnest([subject, object]) as name from g) using (query_id, name) group by 1)
select query_id, id, round(coalesce(score, 0), 6) as score, coalesce(rank, 1) as rank, round(original, 6) as original_score, coalesce(n_triples, 0) as n_triples, coalesce(clickable, '') as clickable from q left join n using (query_id) left join k using (query_id) left join (select * from r where rank <= 5) using (query_id)"""


@query("f10_graph_strategy", f"select query_id, id, score, rank from ({_G20}) where id is not null and rank <= 3")
def graph_strategy(spark, d):
    tables_, queries = _graph_kb(spark, d)
    return retrieval.retrieve("graph", tables_, queries, retrieval.Options(k=3)).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


def _graph_kb(spark, d):
    """Chunks d0_0 to d49_6 with vectors; queries ask for a nation, or for a nation and a region."""
    e = table(spark, d, "embeddings")
    node = F.concat_ws("_", F.concat(F.lit("d"), (F.col("vec_id") % 50).cast("string")), (F.col("vec_id") % 7).cast("string"))
    chunks = e.groupBy(node.alias("id")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey").cast("long")
    words = F.when(key % 3 == 0, F.array().cast("array<string>")).when(key % 3 == 1, F.array(F.lit("PART"))).otherwise(F.array(F.lit("nothing")))
    asked = n.select(key.alias("query_id"), words.alias("keywords")).join(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), "query_id")
    names = F.when(key % 2 == 0, F.array("n_name", "r_name")).otherwise(F.array("n_name"))
    sections = edges(spark, d).withColumn("source_node_id", F.replace("source_node_id", F.lit("_"), F.lit("_section_")))
    return retrieval.Tables(chunks, edges=sections, entities=n.select(key.alias("query_id"), F.explode(names).alias("name"))), asked


@query("g20_graph_retrieve", _G20)
def graph_retrieve(spark, d):
    tables_, queries = _graph_kb(spark, d)
    out = retrieval.graph_retrieve(tables_, queries, {"k": 5})
    return out.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long"), F.round("original_score", 6).alias("original_score"), "n_triples", F.array_join("clickable", "|").alias("clickable"))


@query("e17_resolve_labels", """with m as (select c_nationkey::bigint as query_id, c_custkey as pos, case c_custkey % 4 when 0 then p_name when 1 then upper(left(p_name, 5)) when 2 then 'urn' || c_custkey else p_brand end as token from customer join part on p_partkey = c_custkey),
l as (select 'http://kg/' || case p_size % 3 when 0 then 'class/' else 'inst/' end || replace(p_name, ' ', '_') as uri, p_name as label from part union select 'http://kg/inst/urn' || c_custkey, 'label of ' || c_mktsegment from customer union select 'http://kg/inst/' || p_brand, p_type from part),
a as (select token, uri, label as name from (select distinct token from m) join l on contains(lower(label), lower(token))), n as (select distinct token from m where token not in (select token from a)), b as (select token, uri, split_part(uri, '/', -1) as name from n join (select distinct uri from l) on contains(uri, '/inst/') and contains(lower(split_part(uri, '/', -1)), lower(token))),
c as (select *, case when lower(name) = lower(token) then 100 when starts_with(lower(name), lower(token)) then 60 else 30 end + greatest(0, 20 - (length(name) - length(token))) as s from (select * from a union all select * from b)), best as (select token, uri from c qualify row_number() over (partition by token order by s desc, name, uri) = 1)
select query_id, uri, token from m join best using (token) where contains(uri, '/inst/') qualify row_number() over (partition by query_id order by pos, token) <= 2""")
def resolve_labels(spark, d):
    c, p = table(spark, d, "customer"), table(spark, d, "part")
    k = F.col("c_custkey") % 4
    token = F.when(k == 0, F.col("p_name")).when(k == 1, F.upper(F.substring("p_name", 1, 5))).when(k == 2, F.concat(F.lit("urn"), F.col("c_custkey").cast("string"))).otherwise(F.col("p_brand"))
    m = c.join(p, F.col("p_partkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("long").alias("query_id"), F.col("c_custkey").alias("pos"), token.alias("token"))
    part_uri = F.concat(F.lit("http://kg/"), F.when(F.col("p_size") % 3 == 0, "class/").otherwise("inst/"), F.replace("p_name", F.lit(" "), F.lit("_")))
    labels = p.select(part_uri.alias("uri"), F.col("p_name").alias("label"))
    labels = labels.union(c.select(F.concat(F.lit("http://kg/inst/urn"), F.col("c_custkey").cast("string")), F.concat(F.lit("label of "), "c_mktsegment")))
    labels = labels.union(p.select(F.concat(F.lit("http://kg/inst/"), "p_brand"), "p_type")).distinct()
    return retrieval.resolve_labels(m, labels, labels.select("uri").distinct())


@query("p18_answer_context", f"""with {EDGES}, {_KB}, near as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from sims),
t as (select n_nationkey::bigint as query_id, string_agg('- ' || subject || ' ' || predicate || ' ' || object, chr(10) order by ord) as l from edges join nation on object = n_name group by 1),
c as (select query_id, string_agg('[Chunk ' || rank || '] ' || coalesce(text, ''), chr(10) || chr(10) order by rank) as c from near join documents on doc_id = id where rank <= 10 group by 1)
select query_id, md5(concat_ws(chr(10) || chr(10), '### Graph Relationships (Derived from Knowledge Graph):' || chr(10) || l || chr(10), c)) as context from t full join c using (query_id)""")
def answer_context(spark, d):
    chunks, queries = _kb(spark, d)
    hits = search.knn_exact(chunks, queries, 12, id_col="id", vector_col="vector")
    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_name").alias("object"))
    told = edges(spark, d).join(nation, "object").select("query_id", "ord", "subject", "predicate", "object")
    return retrieval.answer_context(hits, chunks, told).select("query_id", F.md5("context").alias("context"))


@query("o07_class_instances", "select n_name as type, count(*) as n, md5(string_agg(c_name, '|' order by c_name)) as instances from customer join nation on c_nationkey = n_nationkey group by 1")
def class_instances(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("s"), F.col("n_name").alias("type"))
    return ontology.class_instance_lists(c.union(c)).select("type", "n", F.md5(F.array_join("instances", "|")).alias("instances"))


@query("j04_revert", f"with {EDGES} select subject as s, predicate as p, object as o from edges")
def revert(spark, d):
    e = edges(spark, d).select(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"))
    declared = table(spark, d, "region").select(F.inline(F.array(*[F.struct(F.concat(F.lit("C_"), "r_name").alias("s"), F.lit(p).alias("p"), o.alias("o")) for p, o in (("type", F.lit("Class")), ("label", F.col("r_name")), ("subClassOf", F.lit("Place")))])))
    return jobs.revert(e.unionByName(declared))


@query("j02_record_chunks", "select (c_custkey // 2) || '_' || (c_custkey % 2) as chunk_id, c_custkey // 2 as doc_id, c_name || ' (Customer): balance=b' || c_nationkey || ', segment=' || c_mktsegment as content from customer")
def record_chunks(spark, d):
    return _records(spark, d).chunks.select("chunk_id", "doc_id", "content")


@query("j02_linked_facts", """with c as (select 'c' || lpad(c_custkey::varchar, 9, '0') as s, (c_custkey // 2) || '_' || (c_custkey % 2) as k, * from customer)
select s as subject, 'label' as predicate, c_name as object, k as source_node_id from c union all select s, 'segment', c_mktsegment, k from c union all select s, 'balance', 'b' || c_nationkey, k from c union all select s, '_type', 'Customer', k from c""")
def linked_facts(spark, d):
    return _records(spark, d).facts.select("subject", "predicate", "object", "source_node_id")


def _records(spark, d):
    """Two records of customers in each document."""
    c = table(spark, d, "customer")
    name = F.concat(F.lit("c"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    body = F.to_json(F.struct(name.alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("type"), F.col("c_mktsegment").alias("segment"), F.concat(F.lit("b"), F.col("c_nationkey").cast("string")).alias("balance")))
    none = spark.createDataFrame([], "id string, label string")
    docs = c.select(F.expr("c_custkey div 2").alias("doc_id"), body.alias("body"))
    return jobs.ingest_records(docs, spark.createDataFrame([], "subject string, predicate string, object string"), none)


@query("s11_attempt_log", "select event_type as query, case when value < 20 then 'too small' end as error, event_id as result_count, round(value, 2) as elapsed_ms, value >= 20 as succeeded from events")
def attempt_log(spark, d):
    at = fresh_path(spark, "attempts")
    e = table(spark, d, "events")
    rows = e.select("event_id", F.col("event_type").alias("query"), F.when(F.col("value") < 20, "too small").alias("error"), F.col("event_id").alias("result_count"), F.round("value", 2).alias("elapsed_ms"), (F.col("value") >= 20).alias("succeeded"))
    for rest in (0, 1):
        tables.append_attempts(rows.where(F.col("event_id") % 2 == rest), at)
    return spark.read.parquet(at)
