"""Graph reads, ontology promotion, maintenance and status over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvina.operators import graph, maintenance, ontology
from corvina.plans.inputs import EDGES, STATEMENTS, STATUS_EVENTS, edges, statements, status_events
from corvina.plans.registry import query, table
from corvina.streaming import status

_NODES = "nodes as (select distinct unnest([subject, object]) as node from edges)"
_NEAR = f"{_NODES}, names as (select r_name as name from region union select 'NATION_1' union select n_name || ' and more' from nation), near as (select name, node from names, nodes where length(node) > 1 and (contains(lower(node), lower(name)) or contains(lower(name), lower(node))))"


def _names(spark, d):
    r = table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit("NATION_1").alias("x"))
    return r.select("name").union(r.select("x")).union(table(spark, d, "nation").select(F.concat("n_name", F.lit(" and more")))).distinct()


@query("g01_neighbors", f"with {EDGES}, {_NEAR}, h as (select name, subject, predicate, object from edges join near on node = subject union select name, subject, predicate, object from edges join near on node = object) select name, subject, predicate, object from (select *, row_number() over (partition by name order by subject, predicate, object) as n from h) where n <= 100")
def neighbors(spark, d):
    return graph.neighbors(edges(spark, d), _names(spark, d))


@query("g02_relations_between", f"with {EDGES}, {_NODES}, p as (select n_name as e1, r_name as e2 from nation, region where n_nationkey % 5 = r_regionkey), names as (select e1 as name from p union select e2 from p), near as (select name, node from names, nodes where length(node) > 1 and (contains(lower(node), lower(name)) or contains(lower(name), lower(node)))), h as (select s.name as sn, o.name as o2, subject, predicate, object from edges join near s on s.node = subject join near o on o.node = object) select distinct e1, e2, subject, predicate, object from h join p on (sn = e1 and o2 = e2) or (sn = e2 and o2 = e1)")
def relations_between(spark, d):
    pairs = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_nationkey") % 5 == F.col("r_regionkey")).select(F.col("n_name").alias("e1"), F.col("r_name").alias("e2"))
    return graph.relations_between(edges(spark, d), pairs)


@query("g04_relevance_gate", f"with {EDGES}, q as (select n_nationkey as query_id, n_name, case n_nationkey % 3 when 0 then [] when 1 then ['located'] else ['nothing'] end::varchar[] as k from nation), t as (select query_id, k, subject, predicate, object from edges join q on object = n_name), ok as (select query_id from t group by query_id having bool_or(len(k) = 0 or contains(predicate || ' ' || object, k[1]))) select query_id, count(*) as n from t semi join ok using (query_id) group by query_id")
def relevance_gate(spark, d):
    k = F.col("n_nationkey") % 3
    q = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("object"), F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("located"))).otherwise(F.array(F.lit("nothing"))).alias("keywords"))
    t = edges(spark, d).join(q.select("query_id", "object"), "object").select("query_id", "subject", "predicate", "object")
    return graph.relevance_gate(q.select("query_id", "keywords"), t).groupBy("query_id").agg(F.count("*").alias("n"))


@query("g05_triples_for_entities", f"with {EDGES}, f as (select n_name as name from nation), h as (select name, subject, predicate, object, source_node_id from edges join f on name = subject union select name, subject, predicate, object, source_node_id from edges join f on name = object) select name, subject, predicate, object, source_node_id from (select *, row_number() over (partition by name order by subject, predicate, object, source_node_id) as n from h) where n <= 30")
def triples_for_entities(spark, d):
    return graph.triples_for_entities(edges(spark, d), table(spark, d, "nation").select(F.col("n_name").alias("name")))


@query("g06_source_chunks", f"with {STATEMENTS} select distinct source_node_id from statements where s in (select s_name from supplier where s_acctbal > 5000)")
def source_chunks(spark, d):
    st = statements(spark, d).select(F.col("s").alias("subject"), F.col("o").alias("object"), "source_node_id")
    return graph.source_chunks(st, table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_name").alias("name")))


@query("g07_predicates_of", f"with {EDGES} select distinct subject as name, predicate, 'out' as direction from edges join nation on n_name = subject union select distinct object, predicate, 'in' from edges join nation on n_name = object")
def predicates_of(spark, d):
    return graph.predicates_of(edges(spark, d), table(spark, d, "nation").select(F.col("n_name").alias("name")))


@query("g08_expand_entities", f"with {EDGES}, b as (select subject as a, object as b from edges union select object, subject from edges), h as (select distinct n_name as name, b as other from nation join b on a = n_name where b not in (select n_name from nation)) select name, other from (select *, row_number() over (partition by name order by other) as n from h) where n <= 10")
def expand_entities(spark, d):
    return graph.expand_entities(edges(spark, d), table(spark, d, "nation").select(F.col("n_name").alias("name")))


@query("g09_k_hop", f"""with recursive {EDGES}, b as (select subject as a, object as b from edges union select object, subject from edges), h(seed, node, hop) as (select r_name, r_name, 0 from region union select seed, b.b, hop + 1 from h join b on a = node where hop < 3) select seed, node, min(hop) as hop from h group by all""")
def k_hop(spark, d):
    return graph.k_hop(edges(spark, d), table(spark, d, "region").select(F.col("r_name").alias("name")), 3)


@query("g10_path_pattern", f"with {EDGES} select distinct a.subject as a, a.object as b, b.object as c from edges a join edges b on a.object = b.subject where a.predicate = 'placed_by' and b.predicate = 'located_in'")
def path_pattern(spark, d):
    return graph.path_pattern(edges(spark, d), "placed_by", "located_in")


_RULES = [("region", "located_in", "part_of", "in_region"), ("buyer", "placed_by", "located_in", "ships_to")]


def _infer(same: str) -> str:
    return f"""with {EDGES}, r(rule, p1, p2, inferred) as (values {', '.join(map(str, _RULES))}) select distinct a.subject as subject, inferred as predicate, b.object as object, rule from edges a join edges b on a.object = b.subject {same} join r on p1 = a.predicate and p2 = b.predicate
where a.subject <> b.object and not exists (select 1 from edges e where e.subject = a.subject and e.predicate = inferred and e.object = b.object)"""


@query("g11_infer_two_hop", _infer(""))
def infer_two_hop(spark, d):
    return graph.infer_two_hop(edges(spark, d), spark.createDataFrame(_RULES, "rule string, p1 string, p2 string, inferred string"))


@query("g11_infer_in_document", _infer("and a.doc_id = b.doc_id"))
def infer_in_document(spark, d):
    return graph.infer_two_hop(edges(spark, d), spark.createDataFrame(_RULES, "rule string, p1 string, p2 string, inferred string"), "doc_id")


@query("g12_viewer_nodes", f"with {EDGES}, h as (select n_name as name, subject, predicate, object from edges join nation on n_name = subject union select n_name, subject, predicate, object from edges join nation on n_name = object), l as (select subject, object from (select *, row_number() over (partition by name order by subject, predicate, object) as n from h) where n <= 50) select distinct unnest([subject, object]) as node from l")
def viewer_nodes(spark, d):
    return graph.viewer(edges(spark, d), table(spark, d, "nation").select(F.col("n_name").alias("name")))[0]


@query("g16_list_triples", f"with {EDGES} select subject, predicate, object from edges where contains(lower(subject), 'cust') order by subject, predicate, object, ord limit 40 offset 20")
def list_triples(spark, d):
    return graph.list_triples(edges(spark, d), subject="Cust", skip=20, limit=40)[0].select("subject", "predicate", "object")


@query("g17_live_schema", f"with {EDGES} select predicate, count(*) as n from edges group by predicate")
def live_schema(spark, d):
    return graph.live_schema(edges(spark, d)).where("kind = 'predicate'").select(F.col("name").alias("predicate"), "n")


@query("g18_unknown_relations", f"with {EDGES} select distinct p_type as name from part where lower(p_type) not in (select lower(predicate) from edges)")
def unknown_relations(spark, d):
    asked = table(spark, d, "part").select(F.col("p_type").alias("name")).union(edges(spark, d).select(F.upper("predicate")))
    return graph.unknown_relations(asked, edges(spark, d))


@query("g19_clickable_entities", f"with {EDGES}, n as (select distinct replace(lower(node), '_', ' ') as node from (select unnest([subject, object]) as node from edges)), a as (select n_name as name from nation union select p_type from part union select c_name || '_x' from customer) select distinct name from a, n where replace(lower(name), '_', ' ') = node or (length(node) > 1 and (contains(node, replace(lower(name), '_', ' ')) or contains(replace(lower(name), '_', ' '), node)))")
def clickable_entities(spark, d):
    names = table(spark, d, "nation").select(F.col("n_name").alias("name")).union(table(spark, d, "part").select("p_type")).union(table(spark, d, "customer").select(F.concat("c_name", F.lit("_x")))).distinct()
    return graph.clickable_entities(names, edges(spark, d))


@query("o01_collect_evidence", f"with {STATEMENTS} select s, p, o, count(*) as n, max(conf) as confidence from statements group by all")
def collect_evidence(spark, d):
    return ontology.collect_evidence(statements(spark, d))


@query("o02_select_candidates", f"""with {STATEMENTS}, e as (select s, p, o, count(*) as n, max(conf) as c from statements group by all) select s, p, o, nullif(concat_ws(', ', case when c < 0.97 then printf('Low Confidence (%.2f < 0.97)', c) end, case when n < 2 then printf('Insufficient Evidence (%d < 2)', n) end), '') as reason from e""")
def select_candidates(spark, d):
    st = statements(spark, d)
    return ontology.select_candidates(st.select("s", "p", "o").distinct(), ontology.collect_evidence(st), 0.97, 2).select("s", "p", "o", "reason")


_TRI = f"{EDGES}, t as (select subject as s, predicate as p, object as o from edges)"


def _tri(spark, d):
    return edges(spark, d).select(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"))


@query("o03_relation_profile", f"with {_TRI}, k as (select *, row_number() over (partition by p, s order by o) as k from t), r as (select *, row_number() over (partition by p order by k, s, o) as r from k) select p, (select count(*) from t t2 where t2.p = r.p) as n, string_agg(s || ' -> ' || o, '; ' order by r) as examples from r where r <= 5 group by p")
def relation_profile(spark, d):
    return ontology.relation_profile(_tri(spark, d)).select("p", "n", F.array_join("examples", "; ").alias("examples"))


@query("o03_concept_frequency", f"with {_TRI} select concept, count(*) as n from (select unnest([s, o]) as concept from t) group by concept order by n desc, concept limit 80")
def concept_frequency(spark, d):
    return ontology.concept_frequency(_tri(spark, d))


@query("o04_label_of", f"with {_TRI}, l as (select n_name as uri, min(c_name) as label from customer join nation on c_nationkey = n_nationkey where c_acctbal > 0 group by 1), u as (select distinct o as uri from t) select uri, coalesce(label, string_split(uri, '#')[-1]) as label from u left join l using (uri)")
def label_of(spark, d):
    labels = table(spark, d, "customer").where("c_acctbal > 0").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("uri"), F.col("c_name").alias("label"))
    return ontology.label_of(_tri(spark, d).select(F.col("o").alias("uri")).distinct(), labels)


@query("o05_apply_schema", """with c as (select n_name as name, r_name as parent from nation join region on n_regionkey = r_regionkey union select r_name, 'Place' from region), p as (select distinct p_type as name, 'NATION_' || (p_size % 30) as domain, p_brand as range from part)
select name as s, 'type' as p, 'Class' as o from c union select c.name, 'subClassOf', c.parent from c join c k on k.name = c.parent union select name, 'type', 'ObjectProperty' from p union select p.name, 'domain', domain from p join c on c.name = domain union select p.name, 'range', range from p join c on c.name = range""")
def apply_schema(spark, d):
    c = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("parent"))
    c = c.union(table(spark, d, "region").select("r_name", F.lit("Place")))
    p = table(spark, d, "part").select(F.col("p_type").alias("name"), F.concat(F.lit("NATION_"), (F.col("p_size") % 30).cast("string")).alias("domain"), F.col("p_brand").alias("range")).distinct()
    return ontology.apply_schema(c, p)


_PROPS = [("lives", ["located_in"], "Agent", "Place"), ("placed_by", [], "Order", "Agent")]
_TYPES = f"{_TRI}, pr(p, d, r) as (values ('located_in', 'Agent', 'Place'), ('placed_by', 'Order', 'Agent')), types as (select s, d as type from t join pr using (p) union select o, r from t join pr using (p))"


def _types(spark, d):
    return ontology.type_instances(_tri(spark, d), spark.createDataFrame(_PROPS, "name string, source_relations array<string>, domain string, range string"))


@query("o06_type_instances", f"with {_TYPES} select s, type from types")
def type_instances(spark, d):
    return _types(spark, d)


@query("o07_class_stats", f"with {_TYPES} select type, count(distinct s) as n, min(s) as first from types group by type")
def class_stats(spark, d):
    return ontology.class_stats(_types(spark, d))


_HIER = "h as (select l_suppkey as s, l_partkey % 100 as o from lineitem)"


@query("o08_remove_cycles", f"with {_HIER} select s, o, count(*) as n from h where s <> o and not exists (select 1 from h b where b.s = h.o and b.o = h.s) group by s, o")
def remove_cycles(spark, d):
    h = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 100).alias("o"))
    return ontology.remove_cycles(h).groupBy("s", "o").agg(F.count("*").alias("n"))


@query("o09_constraint_counts", """with c as (select n_name as name from nation), p as (select distinct p_type as name, 'NATION_' || (p_size % 30) as domain, 'NATION_' || (p_size % 7) as range from part) select 'domain' as p, count(distinct name) as n from p where domain in (select name from c) union all select 'range', count(distinct name) from p where range in (select name from c)""")
def constraint_counts(spark, d):
    c = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    def named(k):
        return F.concat(F.lit("NATION_"), (F.col("p_size") % k).cast("string"))

    p = table(spark, d, "part").select(F.col("p_type").alias("name"), named(30).alias("domain"), named(7).alias("range")).distinct()
    return ontology.constraint_counts(ontology.apply_schema(c, p))


@query("o11_rdfs_closure", f"""with recursive {_TYPES}, sub as (select n_name as child, r_name as parent from nation join region on n_regionkey = r_regionkey union select r_name, 'Place' from region union select 'Agent', 'Thing' union select 'Place', 'Thing'),
up(child, parent) as (select child, parent from sub union select up.child, sub.parent from up join sub on up.parent = sub.child), i as (select c_name as s, n_name as type from customer join nation on c_nationkey = n_nationkey union select s, type from types) select s, type from i union select s, parent from i join up on child = type""")
def rdfs_closure(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    sub = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    sub = sub.union(region.select("r_name", F.lit("Place"))).union(spark.createDataFrame([("Agent", "Thing"), ("Place", "Thing")], "child string, parent string"))
    own = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("s"), F.col("n_name").alias("type"))
    return ontology.rdfs_closure(sub, own.union(_types(spark, d)).distinct())[1]


@query("o15_evolve_tbox", """with e as (select p_type as class, count(*) as n, list(distinct p_brand) as properties from part where p_size < 20 group by 1), n as (select p_type as class, count(*) as n, list(distinct p_name) as properties from part where p_size >= 10 group by 1)
select class, coalesce(e.n, n.n) as n, array_to_string(list_sort(list_distinct(list_concat(coalesce(e.properties, []), coalesce(n.properties, [])))), ',') as properties from e full join n using (class)""")
def evolve_tbox(spark, d):
    p = table(spark, d, "part")
    a = p.where("p_size < 20").groupBy(F.col("p_type").alias("class")).agg(F.count("*").alias("n"), F.collect_set("p_brand").alias("properties"))
    b = p.where("p_size >= 10").groupBy(F.col("p_type").alias("class")).agg(F.count("*").alias("n"), F.collect_set("p_name").alias("properties"))
    return ontology.evolve_tbox(a, b).select("class", "n", F.array_join("properties", ",").alias("properties"))


@query("o17_align_exact", "with c as (select distinct 'class' as kind, upper(p_name) as name from part), k as (select lower(p_name) as key, min(p_name) as existing from part where p_size < 5 group by 1) select kind, name, existing, case when existing is null then 'new' else 'matched' end as status from c left join k on key = lower(name)")
def align_exact(spark, d):
    p = table(spark, d, "part")
    c = p.select(F.lit("class").alias("kind"), F.upper("p_name").alias("name")).distinct()
    return ontology.align_exact(c, p.where("p_size < 5").select(F.lit("class").alias("kind"), F.col("p_name").alias("name")).distinct())


@query("m01_delete_documents", f"with {EDGES}, gone as (select distinct doc_id from edges where predicate = 'located_in' and confidence > 0.9) select doc_id, count(*) as n from edges where doc_id not in (select doc_id from gone) group by doc_id")
def delete_documents(spark, d):
    e = edges(spark, d)
    gone = e.where("predicate = 'located_in' and confidence > 0.9").select("doc_id").distinct()
    return maintenance.delete_documents(e, gone).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("m02_orphan_nodes", "select c_name as node from customer where c_custkey not in (select o_custkey from orders)")
def orphan_nodes(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_name").alias("node"))
    return maintenance.orphan_nodes(nodes, edges(spark, d).where("predicate = 'placed_by'"))


@query("m03_verify_cleanup", f"with {EDGES}, {STATEMENTS}, gone as (select distinct doc_id from edges where confidence > 0.95) select 'edges' as \"table\", count(*) as residual from edges semi join gone using (doc_id) union all select 'statements', count(*) from statements semi join gone using (doc_id)")
def verify_cleanup(spark, d):
    e = edges(spark, d)
    return maintenance.verify_cleanup({"edges": e, "statements": statements(spark, d)}, e.where("confidence > 0.95").select("doc_id").distinct())


@query("m04_orphans", "select doc_id, quality, toxic from labels anti join documents using (doc_id)")
def orphan_labels(spark, d):
    return maintenance.orphans(table(spark, d, "labels"), table(spark, d, "documents"), "doc_id").select("doc_id", "quality", "toxic")


@query("m05_qa_metrics", f"""with {EDGES}, c as (select doc_id, count(*) as n, avg(length(x)) as mean from (select doc_id, unnest(string_split(text, chr(10))) as x from documents) group by doc_id)
select metric, round(value, 6) as value from (select 'documents' as metric, count(*)::double as value from c union all select 'chunks', sum(n) from c union all select 'mean_length', avg(mean) from c union all select 'candidates', count(*) from edges union all select 'filter_ratio', avg((confidence < 0.7)::int) from edges)""")
def qa_metrics(spark, d):
    chunks = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("content"))
    return maintenance.qa_metrics(chunks, edges(spark, d), 0.7).select("metric", F.round("value", 6).alias("value"))


@query("m06_ingest_counts", f"with {EDGES}, {STATEMENTS}, n as (select doc_id, count(*) as node_count from statements group by 1), t as (select doc_id, count(*) as triple_count, count(distinct subject) as entity_count from edges group by 1) select doc_id, coalesce(node_count, 0) as node_count, coalesce(triple_count, 0) as triple_count, coalesce(entity_count, 0) as entity_count from n full join t using (doc_id)")
def ingest_counts(spark, d):
    return maintenance.ingest_counts(statements(spark, d), edges(spark, d))


@query("m09_example_evict", "select user_id, event_id from (select *, row_number() over (partition by user_id, event_type order by floor(value / 50) desc, ts desc, event_id) as n from events) where n <= 3")
def example_evict(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("kb"), F.col("event_type").alias("backend"), F.floor(F.col("value") / 50).alias("use_count"), F.col("ts").alias("created_at"))
    return maintenance.example_evict(e, 3).select(F.col("kb").alias("user_id"), F.col("id").alias("event_id"))


@query("st1_latest_status", f"with {STATUS_EVENTS} select doc_id, arg_max(status, (ts, event_id)) as status, max(ts) as ts from status_events group by doc_id")
def latest_status(spark, d):
    return status.latest_status(status_events(spark, d))


@query("st2_stale_documents", f"with {STATUS_EVENTS}, l as (select doc_id, arg_max(status, (ts, event_id)) as status, max(ts) as ts from status_events group by doc_id), n as (select max(ts) as now from status_events) select doc_id, status, ts from l, n where (status = 'processing' and epoch(now)::bigint - epoch(ts)::bigint > 600) or (status = 'deleting' and epoch(now)::bigint - epoch(ts)::bigint > 300)")
def stale_documents(spark, d):
    ev = status_events(spark, d)
    return status.stale_documents(ev, ev.agg(F.max("ts")).first()[0])
