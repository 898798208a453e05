"""The registered queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.llm import conversation_repair, curve_search, lm_score, mixing, negatives, packing, pivot_dedup, prefix_bpe, quality, simhash_dedup, suffix_dedup, token_files, url_rules
from corvina.llm.common import table



def tokenizer_path(name: str) -> str:
    """A public tokenizer's file on every machine; the files are never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_rules.judge_urls(pages, url_rules.parse_rules(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op1_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return done.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_curve_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = curve_search.search(table(spark, sf_dir, "embeddings"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op5_gru_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = quality.held_out(F.col("doc_id"), 7)
    done = lm_score.score_documents(table(spark, sf_dir, "documents"), ~held_out)
    return done.select(F.col("id").alias("doc_id"), quality.held_out(F.col("id"), 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = prefix_bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return done.withColumnRenamed("id", "doc_id")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_ids(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return token_files.read_digests(manifest)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return parts.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = pivot_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return parts.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, epochs=2)
    return done.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), "id % 100 = 0")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    summary, repaired = conversation_repair.repair(conversation_repair.damaged(rows), originals=rows)
    return conversation_repair.with_digests(summary, repaired).withColumnRenamed("conv", "conv_id")


QUERIES = {
    "op1_rule_quality": op1_rule_quality,
    "op2_packing": op2_packing,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_curve_search": op4_curve_search,
    "op5_gru_score": op5_gru_score,
    "op7_prefix_bpe": op7_prefix_bpe,
    "op8_token_files": op8_token_files,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_pivot_dedup": op10_pivot_dedup,
    "op6_url_rules": op6_url_rules,
    "op11_source_mix": op11_source_mix,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES = {
    "op6_url_rules": r"""
with u as (
  select page_id,
         case when contains(url, '://') then translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*', 0),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
         case when contains(url, '://') then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from pages
), r(rule, rhost, rpath, action) as (
  values ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'block'),
         ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')
), keyed as (select row_number() over () as n, * from u),
hit as (
  select n, max_by(rule, length(rule)) as rule, max_by(action, length(rule)) as action
  from keyed join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by n
)
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from keyed left join hit using (n)
""",
    "op11_source_mix": r"""
with d as (
  select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, coalesce('0' || source, '1') as source, md5(concat_ws(':', '1', doc_id::varchar, source, text)) as h
  from documents
), s as (
  select source, sum(size)::bigint as source_size, 2.0::double * sum(size)::double as cap, [3.0::double, 1.0, 2.0][1 + (row_number() over (order by source) - 1) % 3] as weight from d group by source
), f as (
  select *, coalesce(sum(cap) over w, 0) as capped, sum(weight) over () - coalesce(sum(weight) over w, 0) as open, sum(source_size) over () as total
  from s window w as (order by cap / weight, source rows between unbounded preceding and 1 preceding)
), t as (
  select source, source_size, least(cap, weight * (select max((1.5::double * total - capped) / open) from f)) as target from s
), b as (
  select *, floor(target + 0.5)::bigint // greatest(source_size, 1) as repeats, floor(target + 0.5)::bigint - (floor(target + 0.5)::bigint // greatest(source_size, 1)) * source_size as rest from t
), g as (
  select source, h, sum(size)::bigint as w, coalesce(sum(sum(size)) over (partition by source order by h rows between unbounded preceding and 1 preceding), 0)::bigint as used from d group by source, h
)
select doc_id, size::bigint as size, source_size, target,
       repeats * size + case when w > 0 then (least(w, greatest(rest - used, 0))::hugeint * size // w)::bigint else 0 end as taken
from d join b using (source) join g using (source, h)
""",
    "op12_hard_negatives": r"""
with v as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.id as anchor_id, b.id, a.label = b.label as alike, list_dot_product(a.q, b.q)::bigint as score from v a join v b on a.id <> b.id where a.id % 100 = 0
), p as (
  select anchor_id, id as positive_id, score as positive_score from s where alike qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, id)::int as rank, id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not alike and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, id) <= 10
""",
    "op13_conversation_repair": r"""
with recursive o as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), '') as key from conversations
), h as (
  select *, xor(list_reduce(list_transform(key, lambda x: ord(x)::bigint), lambda crc, x: list_reduce(range(8), lambda v, i: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, xor(crc, x)), 4294967295::bigint), 4294967295) % 20 as hit from o
), d as (
  select conv_id, turn, case hit when 4 then 'user' else role end as role, case hit when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from h, unnest(range(case hit when 3 then 2 else 1 end)) where hit <> 0
), r as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) as n from d
), f as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when row_number() over (partition by conv_id, role, text order by n) > 1 then 'duplicate'
                 when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else 'sound' end as fault,
         left(role, 1) as c, lag(left(role, 1)) over (partition by conv_id order by n) || left(role, 1) as pair
  from r
), g as (
  select conv_id, n, fault in ('blank', 'duplicate') as gone, case fault when 'truncated' then 3 else 0 end as more,
         case c when 's' then [2, 0, 0, 0] when 'u' then [3, 3, 0, 3] when 'a' then [0, 0, 4, 0] else [0, 0, 0, 0] end as k from f
), v as (
  select conv_id, max(n) + 1 as n, [{'c': 0, 's': ''}, {'c': 6, 's': 'II'}, {'c': 3, 's': 'I'}, {'c': 0, 's': ''}] as b from f group by conv_id
  union all
  select conv_id, n, list_transform([1, 2, 3, 4], lambda q: list_sort([w[q], case when q = 3 then {'c': 3 + w[4].c, 's': 'I' || w[4].s} else {'c': 3 + u.c, 's': 'I' || u.s} end])[1])
  from (
    select conv_id, n, w, list_sort([w[3], {'c': 3 + w[4].c, 's': 'I' || w[4].s}])[1] as u
    from (
      select g.conv_id, g.n, list_transform([1, 2, 3, 4], lambda q: list_sort([
               {'c': 4 + b[q].c, 's': 'D' || b[q].s},
               {'c': case when gone or k[q] = 0 then 999999999 else more + b[k[q]].c end, 's': 'K' || b[k[q]].s},
               {'c': case when gone then 999999999 else 3 + more + b[case q when 3 then 4 else 3 end].c end, 's': 'R' || b[case q when 3 then 4 else 3 end].s}])[1]) as w
      from v join g on g.conv_id is not distinct from v.conv_id and g.n = v.n - 1
    )
  )
), a as (
  select conv_id, b[1].c as cost, b[1].s as audit from v where n = 1
), e as (
  select conv_id, i, letter, count(*) filter (where letter <> 'I') over w as n, count(*) filter (where letter <> 'D') over w as m
  from (select conv_id, unnest(string_split(audit, '')) as letter, unnest(range(length(audit))) as i from a where audit <> '') window w as (partition by conv_id order by i)
), l as (
  select e.conv_id, i, letter, m, case letter when 'I' then '' else text end as text, role, bool_or(letter = 'K' and c = 's' and m = 1) over (partition by e.conv_id) as system
  from e left join f on f.conv_id is not distinct from e.conv_id and f.n = e.n where letter <> 'D'
), t as (
  select conv_id, string_agg(case when letter = 'K' then role when (m - system::int) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by i) as lines from l group by conv_id
), z as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
         count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal from f group by conv_id
)
select x.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
       coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(lines, '')) as repaired_sha256
from (select distinct conv_id from conversations) x left join z on z.conv_id is not distinct from x.conv_id left join a on a.conv_id is not distinct from x.conv_id
left join t on t.conv_id is not distinct from x.conv_id
""",
}
