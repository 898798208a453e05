"""Exports, structured records, evidence, schema views and example memory over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvina.operators import maintenance, ontology, triples
from corvina.plans.inputs import EDGES, edges
from corvina.plans.registry import query, table
from corvina.sources import tables as S


@query("s03_chunk_records", "select l_orderkey, l_linenumber, coalesce(case when l_linenumber > 1 then l_linenumber end, -1) as page, coalesce(case when l_partkey % 2 = 0 then l_returnflag end, '') as section_path from lineitem")
def chunk_records(spark, d):
    line = table(spark, d, "lineitem")
    rows = line.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("page"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_returnflag")).alias("section_path"))
    return S.chunk_records(S.chunks_from_records(S.chunk_records(rows)))


@query("s04_chunk_ids", "select l_orderkey, l_linenumber, case when l_linenumber % 2 = 0 then 'n' || l_partkey else l_orderkey || '_' || l_linenumber end as chunk_id from lineitem")
def chunk_ids(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("idx"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("n"), F.col("l_partkey").cast("string"))).alias("node_id"))
    return S.with_chunk_ids(rows).select("l_orderkey", "l_linenumber", "chunk_id")


_LIT = f"{EDGES}, t as (select subject, predicate, object, false as lit from edges union all select c_name, 'segment', c_mktsegment, true from customer)"


def _with_facts(spark, d):
    e = edges(spark, d).select("subject", "predicate", "object", F.lit(False).alias("is_literal"))
    return e.unionByName(table(spark, d, "customer").select(F.col("c_name").alias("subject"), F.lit("segment").alias("predicate"), F.col("c_mktsegment").alias("object"), F.lit(True).alias("is_literal")))


@query("s06_property_nodes", f"with {_LIT}, e as (select unnest([subject, object]) as iri from t where not lit union select subject from t), f as (select subject as iri, string_agg(distinct predicate || '=' || object, ';' order by predicate || '=' || object) as p from t where lit group by 1) select iri, string_split(iri, '#')[-1] as label, coalesce(p, '') as properties from e left join f using (iri)")
def property_nodes(spark, d):
    return S.property_graph(_with_facts(spark, d))[0].select("iri", "label", F.array_join("properties", ";").alias("properties"))


@query("s06_property_relations", f"with {_LIT} select distinct subject, upper(predicate) as type, object from t where not lit")
def property_relations(spark, d):
    return S.property_graph(_with_facts(spark, d))[1]


_QUADS = f"{EDGES}, quads as (select 'urn:doc:' || doc_id as g, subject as s, predicate as p, object as o from edges union all select 'urn:ontology:kb', n_name, 'type', 'Class' from nation)"


@query("s08_union_graph", f"with {_QUADS} select distinct s, p, o from quads where not starts_with(g, 'urn:ontology:')")
def union_graph(spark, d):
    q = edges(spark, d).select(F.concat(F.lit("urn:doc:"), "doc_id").alias("g"), F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"))
    return S.export_union_graph(q.unionByName(table(spark, d, "nation").select(F.lit("urn:ontology:kb").alias("g"), F.col("n_name").alias("s"), F.lit("type").alias("p"), F.lit("Class").alias("o"))))


@query("s09_export_edges", f"with {EDGES}, u as (select *, 'urn:export:inst/' || url_encode(replace(subject, ' ', '_')) as su, 'urn:export:rel/' || predicate as pu, 'urn:export:inst/' || url_encode(replace(object, ' ', '_')) as ou from edges) select su as s, 'label' as p, subject as o from u union select pu, 'label', predicate from u union select ou, 'label', object from u union select su, pu, ou from u")
def export_edges(spark, d):
    return S.export_edges(edges(spark, d))


@query("t02_structured_to_triples", """with c as (select *, 'c' || c_custkey as id from customer) select c_custkey as doc_id, id as subject, 'label' as predicate, c_name as object, false as is_reference from c union all select c_custkey, id, 'segment', c_mktsegment, false from c
union all select c_custkey, id, 'nation', 'n' || c_nationkey, false from c union all select c_custkey, id, 'knows', 'c' || (c_custkey // 2), true from c union all select c_custkey, id, '_type', 'Customer', false from c""")
def structured_to_triples(spark, d):
    k = F.col("c_custkey")
    body = F.to_json(F.struct(F.concat(F.lit("c"), k.cast("string")).alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("type"), F.col("c_mktsegment").alias("segment"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("nation"), F.concat(F.lit("c"), F.floor(k / 2).cast("string")).alias("knows")))
    return triples.structured_to_triples(table(spark, d, "customer").select(k.alias("doc_id"), body.alias("body")))


@query("t11_section_offsets", f"with {EDGES} select ord, n_nationkey * 100 as source_start, n_nationkey * 100 + 99 as source_end from edges left join nation on n_name = object")
def section_offsets(spark, d):
    sections = table(spark, d, "nation").select(F.col("n_name").alias("section_id"), (F.col("n_nationkey") * 100).alias("start"), (F.col("n_nationkey") * 100 + 99).alias("end"))
    return triples.attach_section_offsets(edges(spark, d).withColumn("section_id", F.col("object")), sections).select("ord", "source_start", "source_end")


@query("t12_evidence_match", f"""with {EDGES}, c as (select distinct doc_id, source_node_id as chunk_id from edges), ct as (select c.doc_id, chunk_id, string_agg(subject || ' ' || object, ' ' order by ord) as content from c join edges e on e.source_node_id = c.chunk_id group by all),
p as (select ord, chunk_id, contains(lower(content), lower(subject)) or contains(lower(content), lower(object)) as named from edges join ct using (doc_id)), q as (select *, max(named) over (partition by ord) as some_named from p)
select ord, chunk_id from (select *, row_number() over (partition by ord order by chunk_id) as n from q where named or not some_named) where n <= 3""")
def evidence_match(spark, d):
    e = edges(spark, d)
    lines = F.sort_array(F.collect_list(F.struct("ord", F.concat_ws(" ", "subject", "object").alias("x"))))
    chunks = e.groupBy("doc_id", F.col("source_node_id").alias("chunk_id")).agg(lines.alias("l")).select("doc_id", "chunk_id", F.array_join(F.transform("l", lambda x: x["x"]), " ").alias("content"))
    return triples.evidence_match(e.select("ord", "doc_id", "subject", "object"), chunks)


_CANDS = "cands as (select 'class' as kind, n_name as name, r_name as parent, null as domain, null as range, 'nation' as comment from nation join region on n_regionkey = r_regionkey union all select 'class', r_name, null, null, null, null from region union all select distinct 'relation', p_type, null, 'NATION_' || (p_size % 25), 'NATION_' || (p_size % 7), null from part)"


def _cands(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nothing = F.lit(None).cast("string")
    a = n.select(F.lit("class").alias("kind"), F.col("n_name").alias("name"), F.col("r_name").alias("parent"), nothing.alias("domain"), nothing.alias("range"), F.lit("nation").alias("comment"))
    b = table(spark, d, "region").select(F.lit("class").alias("kind"), F.col("r_name").alias("name"), *[nothing.alias(c) for c in ("parent", "domain", "range", "comment")])
    ends = [F.concat(F.lit("NATION_"), (F.col("p_size") % k).cast("string")) for k in (25, 7)]
    p = table(spark, d, "part").select(F.lit("relation").alias("kind"), F.col("p_type").alias("name"), nothing.alias("parent"), ends[0].alias("domain"), ends[1].alias("range"), nothing.alias("comment"))
    return a.unionByName(b).unionByName(p.distinct())


_TBOX = f"""{_CANDS}, tbox as (select name as s, 'type' as p, case kind when 'class' then 'Class' else 'ObjectProperty' end as o from cands union select name, 'label', name from cands union select name, 'subClassOf', parent from cands where parent is not null
 union select name, 'domain', domain from cands where domain is not null union select name, 'range', range from cands where range is not null union select name, 'comment', comment from cands where comment is not null)"""


@query("t14_base_ontology_rows", f"with {_TBOX} select s, p, o from tbox")
def base_ontology_rows(spark, d):
    return triples.base_ontology_rows(_cands(spark, d))


@query("t16_candidate_rows", "select distinct case when regexp_matches(lower(p_type), 'class|concept|type|category|abstract|개념|분류') then 'class' else 'instance' end as kind, p_name as name from (select p_name, case when p_size % 3 = 0 then p_type || ' Category' else p_type end as p_type from part)")
def candidate_rows(spark, d):
    kind = F.when(F.col("p_size") % 3 == 0, F.concat("p_type", F.lit(" Category"))).otherwise(F.col("p_type"))
    return triples.candidate_rows(table(spark, d, "part").select(F.col("p_name").alias("name"), kind.alias("type")))


@query("g13_schema_view", f"""with {_TBOX}, c as (select s from tbox where p = 'type' and o = 'Class'), l as (select s as source, o as target, 'subClassOf' as label from tbox where p = 'subClassOf'
 union select d.o, r.o, d.s from tbox d join tbox r on d.s = r.s where d.p = 'domain' and r.p = 'range') select source, target, label from l where source <> target and source in (select s from c) and target in (select s from c)""")
def schema_view(spark, d):
    return ontology.schema_view(triples.base_ontology_rows(_cands(spark, d)))


@query("g14_schema_fallback", f"with {_LIT} select predicate as label, case when bool_or(lit) then 'Literal' else 'Entity' end as target from t group by predicate")
def schema_fallback(spark, d):
    return ontology.schema_fallback(_with_facts(spark, d))


@query("o10_strip_evidence", f"with {EDGES}, t as (select subject as s, predicate as p, object as o from edges union all select 'urn:kg:stmt/' || ord, 'subject', subject from edges union all select subject, 'docId', doc_id from edges) select s, p, o, count(*) as n from t where not contains(s, '/stmt/') and p not in ('sourceNodeId', 'docId', 'confidence') group by all")
def strip_evidence(spark, d):
    e = edges(spark, d)
    t = e.select(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"))
    t = t.union(e.select(F.concat(F.lit("urn:kg:stmt/"), F.col("ord").cast("string")), F.lit("subject"), "subject")).union(e.select("subject", F.lit("docId"), "doc_id"))
    return ontology.strip_evidence(t).groupBy("s", "p", "o").agg(F.count("*").alias("n"))


@query("o12_schema_snapshot", f"with {_TBOX}, more as (select s, p, o from tbox union all select c_name, 'type', n_name from customer join nation on c_nationkey = n_nationkey union all select c_name, 'label', c_name from customer) select distinct s, p, o from more where s in (select s from tbox where p = 'type')")
def schema_snapshot(spark, d):
    return ontology.schema_snapshot(_abox(spark, d))


def _abox(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = triples.base_ontology_rows(_cands(spark, d)).unionByName(c.select(F.col("c_name").alias("s"), F.lit("type").alias("p"), F.col("n_name").alias("o")))
    return rows.unionByName(c.select(F.col("c_name").alias("s"), F.lit("label").alias("p"), F.col("c_name").alias("o")))


@query("o12_instance_types", "select distinct c_name as s, n_name as type from customer join nation on c_nationkey = n_nationkey")
def instance_types(spark, d):
    return ontology.instance_types(_abox(spark, d))


@query("o13_promotion_report", f"with {EDGES} select 'triples' as step, count(*) as value from edges union all select 'confident', count(*) from edges where confidence >= 0.8 union all select 'predicates', count(distinct predicate) from edges")
def promotion_report(spark, d):
    e = edges(spark, d)
    return ontology.promotion_report({"triples": e, "confident": e.where("confidence >= 0.8"), "predicates": e.select("predicate").distinct()})


@query("o14_json_schema_to_tbox", "select distinct p_type as class, p_name as property, case when p_size % 3 = 0 then 'object' else 'datatype' end as kind, case p_size % 3 when 0 then replace(p_brand, '#', '') when 1 then 'dateTime' else 'integer' end as range from part")
def json_schema_to_tbox(spark, d):
    k = F.col("p_size") % 3
    prop = F.when(k == 0, F.concat(F.lit('{"type": "array", "items": {"$ref": "#/$defs/'), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit('"}}'))).when(k == 1, '{"type": "string", "format": "date-time"}').otherwise('{"type": "integer"}')
    body = F.concat(F.lit('{"$defs": {"'), "p_type", F.lit('": {"properties": {"'), "p_name", F.lit('": '), prop, F.lit("}}}}"))
    return ontology.json_schema_to_tbox(table(spark, d, "part").select(body.alias("body")))


@query("o16_schema_candidates", f"with {EDGES}, t as (select predicate, case when predicate = 'located_in' then 'Agent' else 'Entity' end as st, case when predicate = 'part_of' then null else object end as ot from edges union all select 'label', null, null) select distinct 'class' as kind, x as name from (select unnest([st, ot]) as x from t) where x is not null and x <> 'Entity' union select distinct 'property', predicate from t where predicate <> 'label'")
def schema_candidates(spark, d):
    e = edges(spark, d).withColumns({"subject_type": F.when(F.col("predicate") == "located_in", "Agent").otherwise("Entity"), "object_type": F.when(F.col("predicate") != "part_of", F.col("object"))})
    return ontology.schema_candidates(e)


@query("o18_apply_rename", f"with {EDGES} select ord, case predicate when 'located_in' then 'locatedIn' when 'placed_by' then 'placedBy' else predicate end as predicate from edges")
def apply_rename(spark, d):
    e = edges(spark, d)
    names = e.select(F.col("predicate").alias("name")).distinct().withColumn("to", F.when(F.col("name") == "located_in", "locatedIn").when(F.col("name") == "placed_by", "placedBy"))
    return ontology.apply_rename(e, names).select("ord", "predicate")


_COS = "(list_inner_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_inner_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_inner_product(b.embedding::double[], b.embedding::double[]))))"
_EX = f"s as (select b.vec_id as query_id, a.vec_id as id, {_COS} as score from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id and a.vec_id % 2 = 0 and b.vec_id % 2 = 1), r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from s where score >= 0.2)"


def _examples(spark, d):
    e = table(spark, d, "embeddings")
    held = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), F.col("label").alias("kb"), F.lit("x").alias("backend"), F.col("embedding").alias("question_vector"))
    return held, e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("query_id"), F.col("label").alias("kb"), F.lit("x").alias("backend"), F.col("embedding").alias("query_vec"))


@query("m07_example_search", f"with {_EX} select query_id, id, round(score, 6) as score, rank from r where rank <= 3")
def example_search(spark, d):
    held, asked = _examples(spark, d)
    return maintenance.example_search(held, asked, 3, 0.2).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("m08_example_store", f"with {_EX} select id, count(*) as hits from r where rank = 1 group by id")
def example_store(spark, d):
    held, asked = _examples(spark, d)
    return maintenance.example_store(held, asked, 0.2)[0]


@query("m10_delete_kb", f"with {EDGES} select doc_id, count(*) as n from edges where doc_id <> 'd7' group by doc_id")
def delete_kb(spark, d):
    e = edges(spark, d).withColumn("kb_id", F.col("doc_id"))
    return maintenance.delete_kb({"edges": e}, "d7")["edges"].groupBy("doc_id").agg(F.count("*").alias("n"))
