"""Triples and entities over tables that Spark derives from the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvina.functions import text as X
from corvina.operators import entities, triples
from corvina.plans.inputs import EDGES, MENTIONS, STATEMENTS, edges, mentions, statements
from corvina.plans.registry import query, table

#: Edges with some noise: predicates from the noise list, placeholders and particles at the ends.
_NOISY = f"""{EDGES}, noisy as (select ord, case ord % 11 when 0 then 'Unknown' when 1 then subject || '은' when 2 then ' ' || subject || '에서 ' else subject end as subject,
 case ord % 7 when 0 then 'Relation' when 1 then ' ' || predicate when 2 then '속성' when 3 then 'x' else predicate end as predicate, case ord % 13 when 0 then '그' when 1 then object || '의' else object end as object, confidence, doc_id, source_node_id from edges)"""


def _noisy(spark, d):
    e, o = edges(spark, d), F.col("ord")
    s = F.when(o % 11 == 0, "Unknown").when(o % 11 == 1, F.concat("subject", F.lit("은"))).when(o % 11 == 2, F.concat(F.lit(" "), "subject", F.lit("에서 "))).otherwise(F.col("subject"))
    p = F.when(o % 7 == 0, "Relation").when(o % 7 == 1, F.concat(F.lit(" "), "predicate")).when(o % 7 == 2, "속성").when(o % 7 == 3, "x").otherwise(F.col("predicate"))
    t = F.when(o % 13 == 0, "그").when(o % 13 == 1, F.concat("object", F.lit("의"))).otherwise(F.col("object"))
    return e.withColumns({"subject": s, "predicate": p, "object": t})


def _list(words):
    return ", ".join(f"'{w}'" for w in words)


def _entity(x):
    cases = " ".join(f"when list_contains([{_list([p for p in X.PARTICLES if len(p) == n])}], right({x}, {n})) and length({x}) >= {n + 2} then left({x}, length({x}) - {n})" for n in sorted({len(p) for p in X.PARTICLES}, reverse=True))
    return f"trim(regexp_replace(case {cases} else {x} end, '\\s+', ' ', 'g'))"


_VALID = "(length(trim({0})) >= 2 and lower(trim({0})) not in (" + _list(X.PLACEHOLDERS) + ") and trim({0}) not in (" + _list(X.PRONOUNS) + "))"
_FILTERED = f"filtered as (select * from noisy where confidence >= 0.6 and lower(trim(predicate)) not in ({_list([w.lower() for w in X.NOISE_PREDICATES])}) and length(trim(predicate)) > 1 and {_VALID.format('subject')} and {_VALID.format('object')})"
_KEYED = f"select *, {_entity('trim(subject)')} as ks, trim(predicate) as kp, {_entity('trim(object)')} as ko from {{0}}"


@query("t01_parse_triples", r"""with r as (select c_custkey, case c_custkey % 4 when 0 then '```json' || chr(10) || '{"triples": [{"subject": "' || c_name || '", "predicate": "in", "object": "n' || c_nationkey || '"}], "properties": [{"entity": "' || c_name || '", "property": "segment", "value": "' || c_mktsegment || '"}]}' || chr(10) || '```'
 when 1 then '- ' || c_name || ' | located in | n' || c_nationkey || chr(10) || 'junk' || chr(10) || '* a||b' when 2 then '{"triples": [{"subject": "' || c_name || '", "predicate": "of", "object": "x", "confidence": 0.25}]}' else 'nothing here' end as reply from customer)
select c_custkey, 0 as pos, c_name as subject, case c_custkey % 4 when 0 then 'in' when 1 then 'located in' else 'of' end as predicate, case c_custkey % 4 when 2 then 'x' else 'n' || c_nationkey end as object, case c_custkey % 4 when 0 then 0.8 when 1 then 0.7 else 0.25 end::double as confidence from customer where c_custkey % 4 < 3
union all select c_custkey, 1, c_name, 'has_segment', c_mktsegment, 0.9 from customer where c_custkey % 4 = 0""")
def parse_triples(spark, d):
    k, nl = F.col("c_custkey") % 4, F.lit("\n")
    n = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    a = F.concat(F.lit('```json\n{"triples": [{"subject": "'), "c_name", F.lit('", "predicate": "in", "object": "'), n, F.lit('"}], "properties": [{"entity": "'), "c_name", F.lit('", "property": "segment", "value": "'), "c_mktsegment", F.lit('"}]}\n```'))
    b = F.concat(F.lit("- "), "c_name", F.lit(" | located in | "), n, nl, F.lit("junk"), nl, F.lit("* a||b"))
    c = F.concat(F.lit('{"triples": [{"subject": "'), "c_name", F.lit('", "predicate": "of", "object": "x", "confidence": 0.25}]}'))
    replies = table(spark, d, "customer").select("c_custkey", F.when(k == 0, a).when(k == 1, b).when(k == 2, c).otherwise("nothing here").alias("reply"))
    return triples.parse_triples(replies)


@query("t03_link_entity_chunks", f"with {EDGES}, f as (select subject, min(source_node_id) as c from edges group by subject) select ord, coalesce(case when ord % 3 = 0 then source_node_id end, c) as source_node_id from edges left join f using (subject)")
def link_entity_chunks(spark, d):
    e = edges(spark, d)
    bare = e.withColumn("source_node_id", F.when(F.col("ord") % 3 == 0, F.col("source_node_id")))
    return triples.link_entity_chunks(bare, e.select(F.col("subject").alias("entity"), F.col("source_node_id").alias("chunk_id"))).select("ord", "source_node_id")


@query("t04_filter_triples", f"with {_NOISY}, {_FILTERED} select ord, subject, predicate, object from filtered")
def filter_triples(spark, d):
    return triples.filter_triples(_noisy(spark, d), 0.6).select("ord", "subject", "predicate", "object")


@query("t05_dedupe_triples", f"with {_NOISY}, d2 as (select * from noisy union all select ord + 1e14::bigint, ' ' || subject, predicate || ' ', object, confidence, doc_id, source_node_id from noisy), k as ({_KEYED.format('d2')}) select ord from (select ord, row_number() over (partition by ks, kp, ko order by ord) as n from k where ks <> '' and kp <> '' and ko <> '') where n = 1")
def dedupe_triples(spark, d):
    n = _noisy(spark, d)
    again = n.withColumns({"ord": F.col("ord") + 10**14, "subject": F.concat(F.lit(" "), "subject"), "predicate": F.concat("predicate", F.lit(" "))})
    return triples.dedupe_triples(n.unionByName(again)).select("ord")


@query("t06_resolve_duplicates", f"with {STATEMENTS}, r as (select *, hash(0) as z from statements) select s, p, o, min(source_node_id) as first from r group by s, p, o")
def resolve_duplicates(spark, d):
    rows = statements(spark, d).select(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"), F.col("source_node_id").alias("ord"))
    return triples.resolve_duplicates(rows).select(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"), F.col("ord").alias("first"))


@query("t07_postprocess_triples", f"with {_NOISY}, {_FILTERED}, k as ({_KEYED.format('filtered')}), k2 as (select ord, ks as subject, predicate, ko as object from k), k3 as ({_KEYED.format('k2')}) select ord, subject, predicate, object from (select *, row_number() over (partition by ks, kp, ko order by ord) as n from k3 where ks <> '' and kp <> '' and ko <> '') where n = 1")
def postprocess_triples(spark, d):
    return triples.postprocess_triples(_noisy(spark, d), 0.6).select("ord", "subject", "predicate", "object")


_KIN = ["스승", "부모", "형", "남편", "located_in"]
_KIN_EDGES = f"{EDGES}, kin as (select ord, subject, [{_list(_KIN)}][ord % 5 + 1] as predicate, object from edges)"


@query("t08_add_inverse", f"with {_KIN_EDGES}, m(p, q) as (values {', '.join(f'({a!r}, {b!r})' for a, b in triples.INVERSES.items())}) select ord, subject, predicate, object, false as is_inverse from kin union all select ord, object, q, subject, true from kin join m on p = predicate")
def add_inverse(spark, d):
    kind = F.element_at(F.array(*map(F.lit, _KIN)), (F.col("ord") % 5 + 1).cast("int"))
    return triples.add_inverse(edges(spark, d).select("ord", "subject", kind.alias("predicate"), "object"))


@query("t08_add_inverse_prefix", f"with {_KIN_EDGES}, m(p, q) as (values {', '.join(f'({a!r}, {b!r})' for a, b in triples.INVERSES_INGEST.items())}) select ord, subject, predicate, object, false as is_inverse from kin union all select ord, object, coalesce(q, 'inverse_' || predicate), subject, true from kin left join m on p = predicate")
def add_inverse_prefix(spark, d):
    kind = F.element_at(F.array(*map(F.lit, _KIN)), (F.col("ord") % 5 + 1).cast("int"))
    return triples.add_inverse(edges(spark, d).select("ord", "subject", kind.alias("predicate"), "object"), triples.INVERSES_INGEST, "inverse_")


@query("t09_filter_candidates", f"with {EDGES} select predicate, count(*) as n from edges where confidence >= 0.75 group by predicate")
def filter_candidates(spark, d):
    return triples.filter_candidates(edges(spark, d), 0.75).groupBy("predicate").agg(F.count("*").alias("n"))


@query("t10_lookup_types", f"with {EDGES}, n as (select c_name as name, 'Customer' as t, 0 as o from customer union all select n_name, 'Nation', 0 from nation union all select lower(n_name), 'Nation', 1 from nation), b as (select name, arg_min(t, o) as t from n group by name) select ord, b1.t as subject_type, b2.t as object_type from edges left join b b1 on b1.name = subject left join b b2 on b2.name = object")
def lookup_types(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("canonical"), F.lit("Customer").alias("type"), F.array().cast("array<string>").alias("variants"))
    n = table(spark, d, "nation").select(F.col("n_name").alias("canonical"), F.lit("Nation").alias("type"), F.array(F.lower("n_name")).alias("variants"))
    return triples.lookup_types(edges(spark, d), c.unionByName(n)).select("ord", "subject_type", "object_type")


@query("t15_manual_triples", f"with {EDGES} select ord, 'manual_' || source_node_id as doc_id, coalesce(case when ord % 2 = 0 then confidence end, 0.8) as confidence from edges")
def manual_triples(spark, d):
    picked = edges(spark, d).withColumn("confidence", F.when(F.col("ord") % 2 == 0, F.col("confidence")))
    return triples.manual_triples(picked, "source_node_id").select("ord", "doc_id", "confidence")


@query("s05_to_ntriples", f"""with {EDGES}, u as (select *, 'urn:kg:inst/' || regexp_replace(trim(subject), '[^a-zA-Z0-9_가-힣Ѐ-ӿ]+', '_', 'g') as su, 'urn:kg:rel/' || predicate as pu, 'urn:kg:inst/' || regexp_replace(trim(object), '[^a-zA-Z0-9_가-힣Ѐ-ӿ]+', '_', 'g') as ou from edges),
v as (select *, 'urn:kg:stmt/' || substr(sha256(su || '|' || pu || '|' || ou), 1, 16) as st from u),
r as (select doc_id, su as s, pu as p, ou as o from v union all select doc_id, su, 'label', subject from v union all select doc_id, pu, 'label', predicate from v union all select doc_id, ou, 'label', object from v union all select doc_id, st, 'type', 'Statement' from v
 union all select doc_id, st, 'subject', su from v union all select doc_id, st, 'predicate', pu from v union all select doc_id, st, 'object', ou from v union all select doc_id, st, 'sourceNodeId', source_node_id from v union all select doc_id, st, 'docId', doc_id from v union all select doc_id, st, 'confidence', round(confidence, 4)::varchar from v)
select distinct 'urn:doc:' || doc_id as g, s, p, o from r""")
def to_ntriples(spark, d):
    return triples.to_ntriples(edges(spark, d))


@query("s07_merge_edges", f"with {EDGES}, t as (select * from edges where confidence < 0.8), n as (select distinct on (subject, predicate, object) * from edges) select subject, predicate, object from t union all select subject, predicate, object from n anti join t using (subject, predicate, object)")
def merge_edges(spark, d):
    e = edges(spark, d).select("subject", "predicate", "object", "confidence")
    keys = ["subject", "predicate", "object"]
    return triples.merge_edges(e.where("confidence < 0.8"), e, keys).select(*keys)


@query("e01_distinct_entities", f"with {_NOISY}, e as (select distinct trim(unnest([subject, object])) as entity from noisy) select entity from e where entity <> ''")
def distinct_entities(spark, d):
    return entities.distinct_entities(_noisy(spark, d))


_NEAR = "near as (select distinct p_brand || ' ' || p_type || ' ' || (p_size // 10) as x from part)"


def _near(spark, d):
    return table(spark, d, "part").select(F.concat_ws(" ", "p_brand", "p_type", F.floor(F.col("p_size") / 10).cast("string")).alias("entity")).distinct()


def alike_sql(least):
    """Pairs of table near(x): a longest common subsequence by bits, one step for each character of the second string."""
    return f"""s as (select x, length(x) as n, lower(x) as l, map_from_entries(list_transform(list_distinct(string_split(lower(x), '')), lambda c: struct_pack(k := c, v := list_sum(list_transform(range(length(x)), lambda i: case when substr(lower(x), i + 1, 1) = c then 1::bigint << i else 0 end))::bigint))) as pm from near),
p as (select a.x as a, b.x as b, a.n as n, b.n as m, list_reduce(string_split(b.l, ''), lambda v, c: (v + (v & coalesce(a.pm[c], 0))) | (v - (v & coalesce(a.pm[c], 0))), (1::bigint << a.n) - 1) & ((1::bigint << a.n) - 1) as v
from s a join s b on a.x < b.x and least(a.n, b.n) >= {least} / (2 - {least}) * greatest(a.n, b.n) - 1e-9)
select a, b, round(2.0::double * (n - bit_count(v)) / (n + m), 6) as ratio from p where 2.0::double * (n - bit_count(v)) / (n + m) >= {least}"""


@query("e03_similar_strings", f"with {_NEAR}, {alike_sql(0.93)}")
def similar_strings(spark, d):
    return entities.similar_strings(_near(spark, d), 0.93).select("a", "b", F.round("ratio", 6).alias("ratio"))


@query("e03_similar_customers", f"with near as (select c_name as x from customer), {alike_sql(0.85)}")
def similar_customers(spark, d):
    return entities.similar_strings(table(spark, d, "customer"), 0.85, "c_name").select("a", "b", F.round("ratio", 6).alias("ratio"))


# every edge lies in one region
@query("e04_entity_groups", f"""with {EDGES}, place as (select n_name as node, r_name as place from nation join region on n_regionkey = r_regionkey), lives as (select subject as node, place from edges join place on object = node where predicate = 'located_in'),
m as (select * from place union select place, place from place union select * from lives union select subject, place from edges join lives on object = node where predicate = 'placed_by'), best as (select place, arg_min(node, (-length(node), node)) as canonical from m group by place)
select node as entity, canonical from m join best using (place)""")
def entity_groups(spark, d):
    pairs = edges(spark, d).select(F.col("subject").alias("a"), F.col("object").alias("b"))
    return entities.entity_groups(pairs)


@query("e05_normalization_suggestions", f"""with {EDGES}, g as (select c_name as entity, n_name as canonical from customer join nation on c_nationkey = n_nationkey union all select n_name, n_name from nation),
t as (select canonical, count(distinct ord) as n from (select ord, unnest([subject, object]) as entity from edges) join g using (entity) group by canonical)
select canonical, count(*) as n_variants, any_value(n) as n_triples from g join t using (canonical) where entity <> canonical group by canonical""")
def normalization_suggestions(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = c.select(F.col("c_name").alias("entity"), F.col("n_name").alias("canonical")).unionByName(table(spark, d, "nation").select(F.col("n_name").alias("entity"), F.col("n_name").alias("canonical")))
    return entities.normalization_suggestions(g, edges(spark, d)).select("canonical", F.size("variants").cast("long").alias("n_variants"), "n_triples")


@query("e06_apply_mapping", f"with {EDGES}, m as (select n_name as v, r_name as c from nation join region on n_regionkey = r_regionkey) select ord, coalesce(m1.c, subject) as subject, coalesce(m2.c, object) as object from edges left join m m1 on m1.v = subject left join m m2 on m2.v = object")
def apply_mapping(spark, d):
    m = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("variant"), F.col("r_name").alias("canonical"))
    return entities.apply_mapping(edges(spark, d), m).select("ord", "subject", "object")


@query("e07_existing_label_index", "select lower(trim(p_name)) as label, min(p_partkey) as id from part group by 1")
def existing_label_index(spark, d):
    return entities.existing_label_index(table(spark, d, "part").select(F.concat(F.lit(" "), "p_name").alias("label"), F.col("p_partkey").alias("id")))


@query("e08_resolve_to_existing", "with i as (select lower(p_name) as label, min(p_partkey) as id from part group by 1) select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'p' || i.id as subject, 's' || l_suppkey as object from lineitem join part on p_partkey = l_partkey join i on i.label = lower(p_name)")
def resolve_to_existing(spark, d):
    ids = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("label"), "p_partkey")
    index = entities.existing_label_index(ids.select("label", F.col("p_partkey").alias("id"))).withColumn("id", F.concat(F.lit("p"), F.col("id").cast("string")))
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("subject"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("object"))
    return entities.resolve_to_existing(t, ids, index).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "subject", "object")


@query("e09_consolidate_mentions", f"with {MENTIONS} select trim(name) as name, array_to_string(list_sort(list(distinct 't' || id % 3)), ' ') as types, count(distinct id % 10) as n_sources from mentions group by 1")
def consolidate_mentions(spark, d):
    m = mentions(spark, d).select("name", F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("type"), (F.col("id") % 10).alias("source"))
    return entities.consolidate_mentions(m).select("name", F.array_join("types", " ").alias("types"), F.size("sources").cast("long").alias("n_sources"))


@query("e10_parse_groups", "with r as (select p_partkey as batch, p_brand as canonical, unnest([p_brand, p_name, p_type]) as variant from part) select variant, arg_max(canonical, (batch, canonical)) as canonical from r group by variant")
def parse_groups(spark, d):
    line = F.concat(F.lit("1. "), F.concat_ws(", ", "p_brand", "p_name", "p_type"))
    return entities.parse_groups(table(spark, d, "part").select(F.col("p_partkey").alias("batch"), line.alias("line")))


@query("e11_assign_types", "with n as (select name, row_number() over (order by name) - 1 as pos from (select distinct c_name as name from customer)) select name, pos // 40 as batch, pos % 40 as idx, case when (pos // 40 + pos % 40) % 3 = 0 then 'Person' when (pos // 40 + pos % 40) % 3 = 1 then 'Place' else 'Entity' end as type from n")
def assign_types(spark, d):
    names = table(spark, d, "customer").select(F.col("c_name").alias("name"))
    slots = table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 40).alias("batch"), (F.col("c_custkey") % 40).alias("idx"))
    kind = (F.col("batch") + F.col("idx")) % 3
    replies = slots.withColumn("type", F.when(kind == 0, "Person").when(kind == 1, "Place")).where("type is not null")
    return entities.assign_types(names, replies)


_MENTIONED = f"{MENTIONS}, ms as (select id % 97 as chunk_id, p_type as text, case when id % 2 = 0 then 'A' else 'B' end as label, id as ord from mentions join part on p_partkey = id)"


def _mentioned(spark, d):
    return table(spark, d, "part").select((F.col("p_partkey") % 97).alias("chunk_id"), F.col("p_type").alias("text"), F.when(F.col("p_partkey") % 2 == 0, "A").otherwise("B").alias("label"), F.col("p_partkey").alias("ord"))


@query("e12_candidate_counts", f"with {_MENTIONED}, o as (select chunk_id, text, label, min(ord) as ord from ms group by all) select text, count(*) as n, arg_min(label, ord) as label from o group by text")
def candidate_counts(spark, d):
    return entities.candidate_counts(_mentioned(spark, d))


@query("e13_promote_entities", f"with {_MENTIONED}, o as (select chunk_id, text, label, min(ord) as ord from ms group by all), c as (select text, count(*) as n, arg_min(label, ord) as label from o group by text) select text, n, n >= 30 and length(text) >= 5 and label in ('A') as is_promoted from c")
def promote_entities(spark, d):
    return entities.promote_entities(entities.candidate_counts(_mentioned(spark, d)), 30, 5, ["A"]).select("text", "n", "is_promoted")


@query("e14_registry", "select l_partkey as uri, arg_min(l_suppkey, (l_orderkey, l_suppkey)) as label, count(distinct l_suppkey) as n_labels, min(l_orderkey) as first_run, max(l_orderkey) as last_run from lineitem group by l_partkey")
def registry(spark, d):
    c = table(spark, d, "lineitem").select(F.col("l_partkey").alias("uri"), F.col("l_suppkey").alias("label"), F.col("l_orderkey").alias("run"))
    return entities.registry(c).select("uri", "label", F.size("labels").cast("long").alias("n_labels"), "first_run", "last_run")


@query("e16_link_candidates", """with t as (select distinct p_type as token from part union select distinct p_brand || '1' from part union select 'o'), c as (select distinct p_type as candidate from part union select distinct p_brand from part union select distinct p_name from part),
s as (select token, candidate, case when lower(token) = lower(candidate) then 100 when starts_with(lower(candidate), lower(token)) or starts_with(lower(token), lower(candidate)) then 60 else 30 end + greatest(0, 20 - abs(length(candidate) - length(token))) as score
 from t, c where contains(lower(candidate), lower(token)) or contains(lower(token), lower(candidate))) select token, candidate, score::double as score from (select *, row_number() over (partition by token order by score desc, candidate) as n from s) where n = 1""")
def link_candidates(spark, d):
    p = table(spark, d, "part")
    t = p.select(F.explode(F.array("p_type", F.concat("p_brand", F.lit("1")), F.lit("o"))).alias("token")).distinct()
    c = p.select(F.explode(F.array("p_type", "p_brand", "p_name")).alias("candidate")).distinct()
    return entities.link_candidates(t, c)


@query("e18_complete_mapping", "select distinct p_name as name, coalesce(case when length(p_name) % 2 = 0 then upper(p_name) end, p_name) as canonical from part")
def complete_mapping(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("name"))
    m = names.where(F.length("name") % 2 == 0).select(F.col("name").alias("variant"), F.upper("name").alias("canonical")).distinct()
    return entities.complete_mapping(names, m)
