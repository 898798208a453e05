"""Entity resolution over triples and mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions import text as X
from corvina.functions.similarity import string_ratio  # noqa: F401
from corvina.operators.components import connected_components
from corvina.operators.similar import similar_links, similar_strings  # noqa: F401


def distinct_entities(triples: DataFrame) -> DataFrame:
    ends = triples.select(F.explode(F.array("subject", "object")).alias("entity"))
    return ends.select(X.strip_blanks(F.col("entity")).alias("entity")).where("entity <> ''").distinct()


def entity_groups(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(entity, canonical): components of the pairs; the longest name stands for its group, the first of equal ones."""
    parts = connected_components(pairs, a, b)
    best = parts.groupBy("component").agg(F.min(F.struct((-F.length(F.col("node").cast("string"))).alias("n"), "node"))["node"].alias("canonical"))
    return parts.join(best, "component").select(F.col("node").alias("entity"), "canonical")


def normalization_suggestions(groups: DataFrame, triples: DataFrame) -> DataFrame:
    """(canonical, variants, n_triples): a triple that touches a group twice counts once."""
    ends = triples.select("ord", F.explode(F.array_distinct(F.array("subject", "object"))).alias("entity"))
    touched = ends.join(groups, "entity").select("ord", "canonical").distinct().groupBy("canonical").agg(F.count("*").alias("n_triples"))
    variants = groups.where("entity <> canonical").groupBy("canonical").agg(F.sort_array(F.collect_set("entity")).alias("variants"))
    return variants.join(touched, "canonical", "left").withColumn("n_triples", F.coalesce("n_triples", F.lit(0)))


def apply_mapping(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Both ends replaced where the mapping (variant, canonical) has them."""
    out = triples
    for end in ("subject", "object"):
        out = out.join(mapping.select(F.col("variant").alias(end), F.col("canonical").alias("__c")), end, "left").withColumn(end, F.coalesce("__c", end)).drop("__c")
    return out


def existing_label_index(labels: DataFrame) -> DataFrame:
    return labels.groupBy(F.lower(X.strip_blanks(F.col("label"))).alias("label")).agg(F.min("id").alias("id"))


def resolve_to_existing(triples: DataFrame, labels: DataFrame, index: DataFrame) -> DataFrame:
    """New ids whose label the index knows become the known id; labels: (id, label) of the new ids."""
    known = labels.select("id", F.lower(X.strip_blanks(F.col("label"))).alias("label")).join(index.withColumnRenamed("id", "canonical"), "label")
    mapping = known.where("id <> canonical").groupBy(F.col("id").alias("variant")).agg(F.min("canonical").alias("canonical"))
    return apply_mapping(triples, mapping)


def consolidate_mentions(mentions: DataFrame) -> DataFrame:
    rows = mentions.withColumn("name", X.strip_blanks(F.col("name"))).where("name <> ''")
    return rows.groupBy("name").agg(F.sort_array(F.collect_set("type")).alias("types"), F.sort_array(F.collect_set("source")).alias("sources"))


def parse_groups(lines: DataFrame, line: str = "line", batch: str = "batch") -> DataFrame:
    """(variant, canonical) from lines ``name, variant, variant``; later batches win."""
    clean = F.regexp_replace(X.strip_blanks(F.col(line)), r"^(\d+\.|-)\s*", "")
    parts = F.filter(F.transform(F.split(clean, ","), X.strip_blanks), lambda x: x != "")
    rows = lines.select(batch, parts.alias("p")).where("size(p) > 0").select(batch, F.col("p")[0].alias("canonical"), F.explode("p").alias("variant"))
    return rows.groupBy("variant").agg(F.max(F.struct(batch, "canonical"))["canonical"].alias("canonical"))


def assign_types(entities: DataFrame, replies: DataFrame, size: int = 40, default: str = "Entity") -> DataFrame:
    """Entities in batches of ``size`` by name get the type that a reply (batch, idx, type) gives for their place.

    Places count within ranges of the sorted names, so the numbering needs no single task.
    """
    named = entities.select("name").distinct()
    places = named.repartitionByRange("name").sortWithinPartitions("name").withColumn("__part", F.spark_partition_id())
    counts = places.groupBy("__part").agg(F.count("*").alias("n"))
    before = counts.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "start")
    numbered = places.withColumn("k", F.row_number().over(Window.partitionBy("__part").orderBy("name"))).join(F.broadcast(before), "__part")
    at = F.col("start") + F.col("k") - 1
    slots = numbered.select("name", F.floor(at / size).cast("long").alias("batch"), (at % size).cast("long").alias("idx"))
    return slots.join(replies, ["batch", "idx"], "left").select("name", "batch", "idx", F.coalesce("type", F.lit(default)).alias("type"))


def candidate_counts(mentions: DataFrame) -> DataFrame:
    """(text, n, label): a (text, label) counts once a chunk; the label that comes first stays."""
    once = mentions.groupBy("chunk_id", "text", "label").agg(F.min("ord").alias("ord"))
    return once.groupBy("text").agg(F.count("*").alias("n"), F.min(F.struct("ord", "label"))["label"].alias("label"))


def promote_entities(counts: DataFrame, min_freq: int = 3, min_len: int = 2, labels: list[str] | None = None) -> DataFrame:
    ok = (F.col("n") >= min_freq) & (F.length("text") >= min_len)
    return counts.withColumn("is_promoted", ok & F.col("label").isin(labels) if labels else ok)


def registry(candidates: DataFrame) -> DataFrame:
    """(uri, label, labels, first_run, last_run) over runs; candidates: (uri, label, run)."""
    return candidates.groupBy("uri").agg(
        F.min(F.struct("run", "label"))["label"].alias("label"), F.sort_array(F.collect_set("label")).alias("labels"), F.min("run").alias("first_run"), F.max("run").alias("last_run")
    )


def link_candidates(tokens: DataFrame, candidates: DataFrame, gram: int = 3) -> DataFrame:
    """(token, candidate, score), the best candidate of each token: equality, then prefix, then containment; nearness in length adds.

    One contains the other only if the shorter one's first ``gram`` characters occur in the longer, so pairs meet by grams.
    """
    t = tokens.select(F.lower(X.strip_blanks(F.col("token"))).alias("t"), "token").where("t <> ''").distinct()
    c = candidates.select(F.lower(X.strip_blanks(F.col("candidate"))).alias("c"), "candidate").where("c <> ''").distinct()

    def grams(x):
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.length(x) - 1, F.lit(0))), lambda i: F.substr(F.col(x), i + 1, F.lit(gram))))

    def heads(x):
        return F.substring(x, 1, gram)

    # short strings may be shorter than a gram: every suffix's head of up to ``gram`` characters, cut to all its lengths
    def keys(x):
        g = F.flatten(F.transform(grams(x), lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda n: F.substr(s, F.lit(1), n))))
        return F.array_distinct(g)

    ab = t.select("token", "t", heads("t").alias("k")).join(c.select("candidate", "c", F.explode(keys("c")).alias("k")), "k").where(F.col("c").contains(F.col("t")))
    ba = t.select("token", "t", F.explode(keys("t")).alias("k")).join(c.select("candidate", "c", heads("c").alias("k")), "k").where(F.col("t").contains(F.col("c")))
    pairs = ab.select("token", "t", "candidate", "c").union(ba.select("token", "t", "candidate", "c")).distinct()
    base = F.when(F.col("t") == F.col("c"), 100.0).when(F.col("c").startswith(F.col("t")) | F.col("t").startswith(F.col("c")), 60.0).otherwise(30.0)
    scored = pairs.withColumn("score", base + F.greatest(F.lit(0.0), 20.0 - F.abs(F.length("candidate") - F.length("token"))))
    best = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("score"), "candidate"))
    return scored.withColumn("n", best).where("n = 1").select("token", "candidate", "score")


def complete_mapping(candidates: DataFrame, mapping: DataFrame) -> DataFrame:
    return candidates.select("name").distinct().join(mapping.select(F.col("variant").alias("name"), "canonical"), "name", "left").select("name", F.coalesce("canonical", "name").alias("canonical"))


def add_aliases(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """(uri, label) with the aliases (label, alias) of known labels; a label of several entries gives its alias to the first."""
    known = labels.groupBy("label").agg(F.min("uri").alias("uri"))
    more = aliases.join(known, "label").select("uri", F.col("alias").alias("label"))
    return labels.select("uri", "label").unionByName(more).distinct()


def merge_entries(labels: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels (uri, label) with those of merged entries added to the canonical ones, and (uri, same_as), closed over chains.

    merges: (label, old), both known labels. Of entries that merges connect, the smallest uri that is merged into none stands for all.
    """
    known = labels.groupBy("label").agg(F.min("uri").alias("uri"))
    pairs = merges.join(known, "label").select("old", F.col("uri").alias("canonical"))
    pairs = pairs.join(known.withColumnRenamed("label", "old"), "old").select("canonical", F.col("uri").alias("merged")).where("canonical <> merged").distinct()
    parts = connected_components(pairs, "canonical", "merged")
    gone = pairs.select(F.col("merged").alias("node"), F.lit(True).alias("gone")).distinct()
    heads = parts.join(gone, "node", "left").groupBy("component").agg(F.min(F.struct(F.coalesce("gone", F.lit(False)).alias("gone"), "node"))["node"].alias("uri"))
    parts = parts.join(heads, "component").where("node <> uri").select("uri", F.col("node").alias("same_as"))
    moved = labels.join(parts, labels.uri == parts.same_as).select(parts.uri, "label")
    return labels.select("uri", "label").unionByName(moved).distinct(), parts


def load_synonyms(labels: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(uri, label) with entries (label, type, aliases) of a synonym list; unknown labels get a uri of their type."""
    known = labels.groupBy("label").agg(F.min("uri").alias("uri"))
    rows = synonyms.where(F.col("label") != "").join(known, "label", "left")
    made = F.coalesce("uri", F.when(F.col("type") == "class", X.to_uri(F.col("label"), "class")).otherwise(X.to_uri(F.col("label"), "instance")))
    every = F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))
    return labels.select("uri", "label").unionByName(rows.select(made.alias("uri"), F.explode(every).alias("label"))).distinct()
