"""Text, tokens and chunks over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvina.functions import text as X
from corvina.operators import chunking
from corvina.plans.inputs import EDGES, MENTIONS, edges, mentions
from corvina.plans.registry import query, table

_MARKED = "'# ' || source || chr(10) || '1. ' || replace(text, '. ', '.' || chr(10) || chr(10) || '- ') || chr(10) || chr(9) || 'a) end  of' "


def _marked(spark: SparkSession, d: str) -> DataFrame:
    body = F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n- "))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("# "), F.col("source"), F.lit("\n1. "), body, F.lit("\n\ta) end  of")).alias("text"))


_BLANK = r"'^\s+|\s+$'"


def _sub(x: str, pattern: str, to: str = "''", flags: str = "g") -> str:
    return f"regexp_replace({x}, '{pattern}', {to}, '{flags}')"


_clean = f"({_MARKED})"
for _m in (r"\d+[.)\]]", r"\([a-zA-Z0-9가-힣]\)", r"[a-zA-Z][.)\]]", r"[•\-*▪▸→○●◆◇■□]"):
    _clean = _sub(_clean, rf"(?m)^\s*{_m}\s+")
for _p, _t in ((r"\n{3,}", "chr(10) || chr(10)"), (r" {2,}", "' '"), (r"\t+", "' '"), (r"(?m)^[^\S\n]+|[^\S\n]+$", "''"), (r"^\s+|\s+$", "''")):
    _clean = _sub(_clean, _p, _t)


@query("p01_clean_text", f"select doc_id, md5({_clean}) as cleaned, length({_clean}) as n from documents")
def clean_text(spark, d):
    c = X.clean_text(F.col("text"))
    return _marked(spark, d).select("doc_id", F.md5(c).alias("cleaned"), F.length(c).cast("long").alias("n"))


@query("p02_clean_entity_name", f"""select c_custkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(x), '^["'']+|["'']+$', '', 'g'), '^\\d+[.)\\]]\\s*', ''), '^\\([a-zA-Z0-9]\\)\\s*', ''), {_BLANK}, '', 'g') as name
from (select c_custkey, ' "' || (c_custkey % 9) || '. ' || c_name || '" ' as x from customer)""")
def clean_entity_name(spark, d):
    x = F.concat(F.lit(' "'), (F.col("c_custkey") % 9).cast("string"), F.lit(". "), F.col("c_name"), F.lit('" '))
    return table(spark, d, "customer").select("c_custkey", X.clean_entity_name(x).alias("name"))


_norm = _sub(f"({_MARKED})", r"\n\s*\n+", "' [[PARA]] '")
_norm = _sub(_sub(f"replace(replace({_norm}, chr(10), ' '), ' [[PARA]] ', chr(10) || chr(10))", r"[ \t]+", "' '"), r"^\s+|\s+$")


@query("p03_normalize_whitespace", f"select doc_id, md5({_norm}) as normal from documents")
def normalize_whitespace(spark, d):
    return _marked(spark, d).select("doc_id", F.md5(X.normalize_whitespace(F.col("text"))).alias("normal"))


_particles = "|".join(sorted(X.PARTICLES, key=len, reverse=True))
_stem = " ".join(
    f"when list_contains([{', '.join(repr(p) for p in X.PARTICLES if len(p) == n)}], right(x, {n})) and length(x) >= {n + 2} then left(x, length(x) - {n})"
    for n in sorted({len(p) for p in X.PARTICLES}, reverse=True)
)


@query("p04_normalize_entity", f"with {MENTIONS} select id, trim(regexp_replace(case {_stem} else x end, '\\s+', ' ', 'g')) as entity from (select id, trim(name) as x from mentions)")
def normalize_entity(spark, d):
    return mentions(spark, d).select("id", X.normalize_entity(F.col("name")).alias("entity"))


@query("p05_canonical_entity", r"""select s_suppkey, trim(regexp_replace(regexp_replace(regexp_replace(trim(x), '^["'']+|["'']+$', '', 'g'), '^\([a-zA-Z0-9]\)\s*', ''), '\s+', ' ', 'g')) as entity,
 trim(regexp_replace(p, '\s+', ' ', 'g')) as predicate from (select s_suppkey, '  ''(' || (s_suppkey % 10) || ')  ' || replace(s_name, '#', '   ') || ''' ' as x, ' is   part  of ' || s_nationkey as p from supplier)""")
def canonical_entity(spark, d):
    x = F.concat(F.lit("  '("), (F.col("s_suppkey") % 10).cast("string"), F.lit(")  "), F.replace("s_name", F.lit("#"), F.lit("   ")), F.lit("' "))
    p = F.concat(F.lit(" is   part  of "), F.col("s_nationkey").cast("string"))
    return table(spark, d, "supplier").select("s_suppkey", X.canonical_entity(x).alias("entity"), X.normalize_predicate(p).alias("predicate"))


_QP = "|".join(X.QUERY_PARTICLES)
_question = "p_name || tail || '? ' || p_brand || '는 ' || p_type || '에서, 나'"


@query("p06_strip_query_particles", f"""with q as (select p_partkey, unnest(string_split_regex(trim(x), '\\s+')) as w from (select p_partkey, {_question.replace("tail", "(['은','의','에게','로'][p_partkey % 4 + 1])")} as x from part)),
b as (select distinct p_partkey, case when regexp_matches(v, '^.+({_QP})$') then regexp_replace(v, '({_QP})$', '') else v end as token from (select p_partkey, regexp_replace(w, '[.,?!]+$', '') as v from q))
select p_partkey, string_agg(token, ' ' order by token) as tokens from b where length(token) > 1 group by p_partkey""")
def strip_query_particles(spark, d):
    tail = F.element_at(F.array(*map(F.lit, ["은", "의", "에게", "로"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    q = F.concat("p_name", tail, F.lit("? "), F.col("p_brand"), F.lit("는 "), F.col("p_type"), F.lit("에서, 나"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(X.strip_query_particles(q)), " ").alias("tokens"))


_stops = "|".join(X.STOP_ROOTS)


@query("p07_relevance_keywords", f"""with q as (select p_partkey, p_brand, unnest(string_split_regex(replace(p_name || '과 ' || p_brand || '의 관계는 무엇 ' || p_type || '에게 누구?', '?', ''), '\\s+')) as w from part),
t as (select p_partkey, p_brand, regexp_replace(w, '[{X.TRAILING_CHARS}]+$', '') as k from q)
select p_partkey, string_agg(k, ' ' order by k) as keywords from t where length(k) > 1 and k <> p_brand and not regexp_matches(k, '^({_stops})') group by p_partkey""")
def relevance_keywords(spark, d):
    q = F.concat("p_name", F.lit("과 "), F.col("p_brand"), F.lit("의 관계는 무엇 "), F.col("p_type"), F.lit("에게 누구?"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(X.relevance_keywords(q, F.array("p_brand"))), " ").alias("keywords"))


@query("p08_sanitize_uri", f"with {MENTIONS} select id, coalesce(nullif(regexp_replace(trim(name), '[^a-zA-Z0-9_가-힣Ѐ-ӿ]+', '_', 'g'), ''), 'unknown') as uri from mentions")
def sanitize_uri(spark, d):
    return mentions(spark, d).select("id", X.sanitize_uri(F.col("name")).alias("uri"))


@query("p09_to_uri", r"select c_custkey, 'urn:onto:inst/' || trim(regexp_replace(c_name || '!', '[^\p{L}\p{N}]', '_', 'g'), '_') as uri, 'urn:onto:class/' || trim(regexp_replace(c_mktsegment, '[^\p{L}\p{N}]', '_', 'g'), '_') as class_uri from customer")
def to_uri(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.to_uri(F.concat("c_name", F.lit("!")), "instance").alias("uri"), X.to_uri(F.col("c_mktsegment"), "class").alias("class_uri"))


@query("p10_local_name", f"""with {EDGES} select ord, string_split(subject, '#')[-1] as name, case when ord % 2 = 0 then 'rel:' else 'prop:' end || predicate as short,
 replace(replace(subject, '#', '_'), '_', ' ') as label from edges""")
def local_name(spark, d):
    e = edges(spark, d)
    kind = F.when(F.col("ord") % 2 == 0, F.lit("urn:x/rel/")).otherwise(F.lit("urn:x/prop/"))
    return e.select("ord", X.local_name(F.concat(F.lit("urn:x/"), F.col("subject"))).alias("name"), X.short_predicate(F.concat(kind, F.col("predicate"))).alias("short"),
                    X.label_from_uri(F.concat(F.lit("urn:x/inst/"), F.replace("subject", F.lit("#"), F.lit("_")))).alias("label"))


@query("p11_safe_node_label", """select p_partkey, case when b in ('', 'Entity') then null when regexp_matches(b, '^[0-9]') then 'T_' || b else b end as label
from (select p_partkey, regexp_replace(case p_partkey % 3 when 0 then p_size || ' ' || p_type when 1 then 'Entity' else p_name || '님!' end, '[^a-zA-Z0-9_가-힣]', '', 'g') as b from part)""")
def safe_node_label(spark, d):
    x = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" "), F.col("p_type"))).when(F.col("p_partkey") % 3 == 1, "Entity").otherwise(F.concat("p_name", F.lit("님!")))
    return table(spark, d, "part").select("p_partkey", X.safe_node_label(x).alias("label"))


@query("p12_class_from_key", """select p_partkey, upper(left(k, 1)) || substr(k, 2) as class_name from (select p_partkey, case when x like '%ies' then left(x, length(x) - 3) || 'y' when x like '%s' then left(x, length(x) - 1) else x end as k
from (select p_partkey, p_name || ['s', 'ies', ''][p_partkey % 3 + 1] as x from part))""")
def class_from_key(spark, d):
    tail = F.element_at(F.array(F.lit("s"), F.lit("ies"), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", X.class_from_key(F.concat("p_name", tail)).alias("class_name"))


@query("p14_chunk_ids", """select l_orderkey, l_linenumber, l_orderkey || '|' || l_suppkey || '|' || lpad(l_linenumber::varchar, 4, '0') as chunk_id,
 md5(l_orderkey || '/' || l_partkey) as chunk_hash, case when length(l_orderkey || '::struct::' || i) > 120 then l_orderkey || '::struct::' || substr(sha1(i), 1, 16) else l_orderkey || '::struct::' || i end as struct_id
from (select *, repeat('p' || l_partkey || '-', 10 + l_linenumber * 3) as i from lineitem)""")
def chunk_ids(spark, d):
    identity = F.repeat(F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit("-")), 10 + F.col("l_linenumber") * 3)
    line = table(spark, d, "lineitem")
    return line.select("l_orderkey", "l_linenumber", X.chunk_id(F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_linenumber")).alias("chunk_id"),
                       F.md5(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"))).alias("chunk_hash"), X.structured_id(F.col("l_orderkey"), identity).alias("struct_id"))


@query("p15_normalize_chunk_ref", f"with {EDGES} select ord, replace(replace(source_node_id, '_', '_section_'), '_section_', '_') as ref from edges")
def normalize_chunk_ref(spark, d):
    return edges(spark, d).select("ord", X.normalize_chunk_ref(F.replace("source_node_id", F.lit("_"), F.lit("_section_"))).alias("ref"))


@query("p16_verbalize_entity", "select c_custkey, c_name || ' (Customer): segment=' || c_mktsegment || ', nation=n' || c_nationkey as line from customer")
def verbalize_entity(spark, d):
    pairs = F.array(F.struct(F.lit("segment").alias("key"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("nation").alias("key"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("value")))
    return table(spark, d, "customer").select("c_custkey", X.verbalize_entity(F.col("c_name"), F.lit("Customer"), pairs).alias("line"))


@query("p17_preview_text", "select doc_id, md5(substr(text, 1, 200)) as p200, md5(substr(text, 1, 2000)) as p2000 from documents")
def preview_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.preview_text(F.col("text"), 200)).alias("p200"), F.md5(X.preview_text(F.col("text"), 2000)).alias("p2000"))


@query("p18_format_context", f"""with {EDGES} select object as query_id, md5(string_agg('- ' || subject || ' ' || predicate || ' ' || object, chr(10) order by ord)) as context, count(*) as n from edges group by object""")
def format_context(spark, d):
    lines = F.struct("ord", F.concat(F.lit("- "), F.concat_ws(" ", "subject", "predicate", "object")).alias("line"))
    g = edges(spark, d).groupBy(F.col("object").alias("query_id")).agg(F.sort_array(F.collect_list(lines)).alias("l"), F.count("*").alias("n"))
    return g.select("query_id", F.md5(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("context"), "n")


@query("k01_tokenize", r"select doc_id, len(t) as n_tokens, md5(array_to_string(t, ' ')) as tokens from (select doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') as t from documents)")
def tokenize(spark, d):
    t = table(spark, d, "documents").withColumn("t", X.tokens(F.col("text")))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens"))


_titles = "|".join(X.TITLES)


@query("k03_extract_entities", f"""with w as (select id, unnest(string_split_regex(trim(x), '\\s+')) as w from (select p_partkey as id, ['김철수','이영희','박','최민수정'][p_partkey % 4 + 1] || ['', '님', '선생', '!'][p_partkey % 5 % 4 + 1] || ' ' || p_name || ' 홍길동' as x from part)),
c as (select id, regexp_replace(w, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g') as c from w), b as (select distinct id, regexp_replace(c, '({_titles})$', '') as e from c where regexp_matches(c, '^[가-힣]{{2,4}}({_titles})?$'))
select id, string_agg(e, ' ' order by e) as entities from b where length(e) >= 2 group by id""")
def extract_entities(spark, d):
    k = F.col("p_partkey")
    name = F.element_at(F.array(*map(F.lit, ["김철수", "이영희", "박", "최민수정"])), (k % 4 + 1).cast("int"))
    tail = F.element_at(F.array(*map(F.lit, ["", "님", "선생", "!"])), (k % 5 % 4 + 1).cast("int"))
    x = F.concat(name, tail, F.lit(" "), F.col("p_name"), F.lit(" 홍길동"))
    return table(spark, d, "part").select(k.alias("id"), F.array_join(X.extract_entities(x), " ").alias("entities"))


@query("k05_question_nouns", f"with {MENTIONS}, w as (select distinct id, unnest(regexp_extract_all(name || '누가 관계', '[가-힣]{{2,}}')) as w from mentions) select id, string_agg(w, ' ' order by w) as nouns from w where w <> '관계' group by id")
def question_nouns(spark, d):
    found = mentions(spark, d).select("id", X.question_nouns(F.concat("name", F.lit("누가 관계")), ["관계"]).alias("n"))
    return found.select("id", F.array_join(F.array_sort("n"), " ").alias("nouns"))


_flags = ", ".join(f"case when regexp_matches(lower(x), '{'|'.join(w)}') then '{k}' end" for k, w in X.RELATION_WORDS.items())


@query("k06_relation_flags", f"select conv_id, turn, coalesce(array_to_string([{_flags}], ' '), '') as families from (select conv_id, turn, text || [' Teacher', ' 관계', ' lean', ''][turn % 4 + 1] as x from conversations)")
def relation_flags(spark, d):
    tail = F.element_at(F.array(F.lit(" Teacher"), F.lit(" 관계"), F.lit(" lean"), F.lit("")), (F.col("turn") % 4 + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(X.relation_families(F.concat("text", tail)), " ").alias("families"))


@query("k07_detect_multihop", f"with {MENTIONS} select id, len(regexp_extract_all(name || '의 집', '의')) >= 2 as multi_hop from mentions")
def detect_multihop(spark, d):
    return mentions(spark, d).select("id", X.is_multi_hop(F.concat("name", F.lit("의 집"))).alias("multi_hop"))


@query("k08_gazetteer", r"""with words as (select distinct doc_id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) as w from documents),
patterns as (select distinct unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: length(x) > 5)) as p from benchmark)
select doc_id, count(*) as n_names, md5(string_agg(p, ' ' order by p)) as names from words join patterns on w = p group by doc_id""")
def gazetteer(spark, d):
    patterns = table(spark, d, "benchmark").select(F.explode(F.filter(X.tokens(F.col("text")), lambda w: F.length(w) > 5)).alias("name")).distinct().withColumn("label", F.lit("TERM"))
    hits = chunking.gazetteer_match(table(spark, d, "documents").select("doc_id", "text"), patterns)
    return hits.groupBy("doc_id").agg(F.count("*").alias("n_names"), F.md5(F.array_join(F.array_sort(F.collect_list("name")), " ")).alias("names"))


@query("c06_sentence_windows", r"""with s as (select doc_id, unnest(range(len(l))) as pos, unnest(l) as sentence from (select doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n\n+'), lambda x: trim(x, chr(10) || ' ')), lambda x: x <> '') as l from documents))
select doc_id, pos, md5(string_agg(sentence, ' ') over (partition by doc_id order by pos rows between 3 preceding and 3 following)) as near from s""")
def sentence_windows(spark, d):
    return chunking.sentence_windows(table(spark, d, "documents"), 3).select("doc_id", "pos", F.md5("window").alias("near"))


@query("c07_markdown_sections", f"""with l as (select doc_id, unnest(range(len(l))) as n, unnest(l) as line from (select doc_id, string_split({_MARKED} || chr(10) || '## ' || lang || chr(10) || text, chr(10)) as l from documents)),
s as (select *, sum(case when regexp_matches(line, '^#{{1,3}} ') then 1 else 0 end) over (partition by doc_id order by n) as section from l)
select doc_id, section, count(*) as n_lines, md5(string_agg(line, chr(10) order by n)) as content from s group by doc_id, section""")
def markdown_sections(spark, d):
    m = _marked(spark, d).join(table(spark, d, "documents").select("doc_id", "lang", F.col("text").alias("body")), "doc_id")
    whole = m.select("doc_id", F.concat("text", F.lit("\n## "), "lang", F.lit("\n"), "body").alias("text"))
    return chunking.markdown_sections(whole).select("doc_id", "section", "n_lines", F.md5("content").alias("content"))


@query("c13_fixed_windows", """select doc_id, unnest(range(0, greatest(length(text), 0), 500)) // 500 as chunk_index, md5(substr(text, unnest(range(0, greatest(length(text), 0), 500)) + 1, 500)) as chunk from documents""")
def fixed_windows(spark, d):
    return chunking.fixed_windows(table(spark, d, "documents"), 500).select("doc_id", F.col("chunk_index").cast("long"), F.md5("content").alias("chunk"))


@query("c16_order_chunks", "select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by case when l_linenumber % 3 = 0 then l_partkey else l_linenumber * 10000 end, l_linenumber, l_partkey, l_suppkey) as place from lineitem")
def order_chunks(spark, d):
    line = table(spark, d, "lineitem").withColumn("start_char_idx", F.when(F.col("l_linenumber") % 3 == 0, F.col("l_partkey")))
    w = Window.partitionBy("l_orderkey").orderBy(chunking.chunk_order(F.col("start_char_idx"), F.col("l_linenumber")), "l_linenumber", "l_partkey", "l_suppkey")
    return line.select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("place"))


@query("c17_sentence_split", r"""select doc_id, len(l) as n, md5(array_to_string(l, '|')) as sentences from (select doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n\n+'), lambda x: trim(x, chr(10) || ' ')), lambda x: x <> '') as l from documents)""")
def sentence_split(spark, d):
    s = table(spark, d, "documents").withColumn("s", X.sentences(F.col("text")))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("sentences"))
