"""Whole jobs, composed of the library's operators; each is a lazy plan over its tables unless it is said to write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions import text as X
from corvina.operators import chunking, entities, graph, maintenance, ontology, triples
from corvina.operators.search import hashed_embedding
from corvina.session import saved, tasks_of
from corvina.sources import tables

KEYS = ["subject", "predicate", "object"]


@dataclass(frozen=True)
class Ingested:
    """Chunks, their vectors, the dictionary of names, suggestions to merge names, the triples found, and the edge table with those merged in."""

    chunks: DataFrame
    vectors: DataFrame
    dictionary: DataFrame | None
    suggestions: DataFrame
    triples: DataFrame
    edges: DataFrame


def name_dictionary(mentions: DataFrame, lines: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(canonical, type, variants) of mentions (name, type, source), and the mapping (variant, canonical) behind it.

    lines: (batch, line) of a grouper's replies, ``name, variant, variant``. Of a name's types the first by alphabet counts.
    """
    names = entities.consolidate_mentions(mentions).select("name", F.col("types")[0].alias("type"))
    groups = entities.parse_groups(lines) if lines is not None else names.select(F.col("name").alias("variant"), F.col("name").alias("canonical")).where("false")
    mapping = entities.complete_mapping(names, groups).select(F.col("name").alias("variant"), "canonical")
    told = names.join(mapping.withColumnRenamed("variant", "name"), "name").groupBy("canonical").agg(F.min("type").alias("type"), F.sort_array(F.collect_set("name")).alias("variants"))
    return told, mapping.where("variant <> canonical")


def normalized(found: DataFrame, alike: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """Triples (ord, subject, predicate, object, …), which are saved, under the names that suggestions choose, each once, and the suggestions."""
    found = saved(found, "found")  # the search and what comes after it both read them
    groups = similar_groups(found, alike)
    suggestions = entities.normalization_suggestions(groups, found)
    told = entities.apply_mapping(found, groups.where("entity <> canonical").select(F.col("entity").alias("variant"), "canonical"))
    named = {"subject": X.canonical_entity(F.col("subject")), "object": X.canonical_entity(F.col("object")), "predicate": X.normalize_predicate(F.col("predicate"))}
    return triples.resolve_duplicates(told.withColumns(named)), suggestions


def similar_groups(found: DataFrame, alike: float = 0.85) -> DataFrame:
    """(entity, canonical) of names that chains of similar names connect; saved, as the search and the components are work."""
    return saved(entities.entity_groups(entities.similar_links(entities.distinct_entities(found), alike)), "groups")


def ingest_text(
    docs: DataFrame, replies: DataFrame, known: DataFrame, rules: DataFrame | None = None, size: int = 1_000, overlap: int = 200, least: float = 0.5, alike: float = 0.85,
    mentions: DataFrame | None = None, lines: DataFrame | None = None,
) -> Ingested:
    """Texts (doc_id, text) to chunks and vectors; an extractor's replies (ord, doc_id, reply) to triples among ``known`` edges.

    Mentions (name, type, source) and groups of names (batch, line) make a dictionary, whose canonical names and types the
    triples take. Replies are parsed, filtered and normalised; similar names take the name that stands for their group.
    Rules (rule, p1, p2, inferred) then add edges within each document.
    """
    clean = docs.select("doc_id", X.clean_text(F.col("text")).alias("text"))
    chunks = chunking.chunk_by_size(clean, size, overlap)
    chunks = chunks.withColumn("chunk_id", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))
    vectors = hashed_embedding(chunks, X.tokens(F.col("content")), "chunk_id")
    # a small file is one task's: parsing it is much work for few bytes
    found, dictionary = triples.postprocess_triples(triples.parse_triples(replies.repartition(tasks_of(replies.sparkSession), "ord")), least), None
    if mentions is not None:
        dictionary, mapping = name_dictionary(mentions, lines)
        found = triples.lookup_types(entities.apply_mapping(found, mapping), dictionary)
    found, suggestions = normalized(found, alike)
    edges = triples.merge_edges(known.select(*KEYS, "doc_id"), found.select(*KEYS, F.col("doc_id").cast(known.schema["doc_id"].dataType)), KEYS)
    if rules is not None:
        inferred = graph.infer_two_hop(edges, rules, "doc_id").select(*KEYS, F.lit(None).cast(known.schema["doc_id"].dataType).alias("doc_id"))
        edges = edges.unionByName(inferred.dropDuplicates(KEYS))
    return Ingested(chunks, vectors, dictionary, suggestions, found, edges)


def store(done: Ingested, root: str, kb: str) -> None:
    """Writes chunks and vectors of a knowledge base next to those of others, and its edges in place of the old ones."""
    rows = done.chunks.withColumnRenamed("chunk_id", "node_id").withColumnRenamed("chunk_index", "idx")
    tables.write_chunks(rows, f"{root}/chunks", kb)
    done.vectors.withColumn("kb_id", F.lit(kb)).write.mode("append").partitionBy("kb_id").parquet(f"{root}/vectors")
    done.edges.write.mode("overwrite").parquet(f"{root}/edges/kb_id={kb}")


@dataclass(frozen=True)
class Structured:
    """One chunk for each entity of the records, its vector, the facts with their chunks, and the edge table with those merged in."""

    chunks: DataFrame
    vectors: DataFrame
    facts: DataFrame
    edges: DataFrame


def structured_facts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Facts of JSON records (doc_id, body); ids whose label is known become the known id. labels: (id, label) of known entities."""
    facts = triples.structured_to_triples(docs)
    new = facts.where("predicate = 'label'").select(F.col("subject").alias("id"), F.col("object").alias("label"))
    return entities.resolve_to_existing(facts, new, entities.existing_label_index(labels))


def ingest_structured(docs: DataFrame, known: DataFrame, labels: DataFrame) -> DataFrame:
    """The edge table ``known`` with the facts of JSON records (doc_id, body). No inverse edges are added."""
    return triples.merge_edges(known.select(*KEYS), structured_facts(docs, labels).select(*KEYS), KEYS)


def ingest_records(docs: DataFrame, known: DataFrame, labels: DataFrame) -> Structured:
    """``ingest_structured`` with a chunk for each entity: its label, type and fields as a line, under the first document that tells of it.

    A chunk's id is that document's, an underscore and the entity's place among the document's entities by name. Facts
    carry the chunk of their subject.
    """
    facts = structured_facts(docs, labels)
    own = F.struct(F.col("predicate").alias("key"), F.col("object").alias("value"))
    is_field = ~F.col("predicate").isin("label", "_type")
    told = facts.groupBy("subject").agg(
        F.min("doc_id").alias("doc_id"), F.min(F.when(F.col("predicate") == "label", F.col("object"))).alias("label"), F.min(F.when(F.col("predicate") == "_type", F.col("object"))).alias("type"),
        F.array_sort(F.collect_set(F.when(is_field, own))).alias("fields"),
    )
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("subject")) - 1
    line = X.verbalize_entity(F.coalesce("label", "subject"), F.coalesce("type", F.lit("Entity")), F.col("fields"))
    chunks = told.withColumn("chunk_id", F.concat_ws("_", F.col("doc_id").cast("string"), place.cast("string"))).select("chunk_id", "doc_id", "subject", line.alias("content"))
    mentions = chunks.select(F.col("subject").alias("entity"), "chunk_id")
    linked = triples.link_entity_chunks(facts.withColumn("source_node_id", F.lit(None).cast("string")), mentions)
    vectors = hashed_embedding(chunks, X.tokens(F.col("content")), "chunk_id")
    return Structured(chunks, vectors, linked, triples.merge_edges(known.select(*KEYS), facts.select(*KEYS), KEYS))


@dataclass(frozen=True)
class Ontology:
    """Candidates, declarations (s, p, o), evidence, the registry of names, and quality figures."""

    candidates: DataFrame
    declarations: DataFrame
    evidence: DataFrame
    registry: DataFrame
    metrics: DataFrame


def build_ontology(docs: DataFrame, run: str, version: str = "1", least: float = 0.5) -> Ontology:
    """From texts (doc_id, text): chunks, candidates by sentence patterns, declarations, evidence, registry and figures."""
    chunks = chunking.chunk_oe(docs)
    chunks = chunks.withColumn("chunk_id", X.chunk_id(F.col("doc_id"), F.lit(version), F.col("chunk_index")))
    every = triples.candidate_patterns(chunks, "chunk_id", "content")
    kept = triples.filter_candidates(every, least)
    nothing = F.lit(None).cast("string")
    is_class, literal = F.col("kind") == "class", F.col("is_literal")
    named = kept.select(
        "kind", F.when(is_class, F.col("subject")).otherwise(F.col("predicate")).alias("name"), nothing.alias("parent"), F.when(~is_class, F.col("subject")).alias("domain"),
        F.when(~is_class & ~literal, F.col("object")).alias("range"), F.when(is_class, F.col("object")).alias("comment"),
    )
    places = chunks.select("chunk_id", F.concat(F.lit("urn:ragchunk:"), "chunk_id").alias("graph"), F.concat(F.lit("chunk:"), "chunk_id").alias("uri"), F.sha2("content", 256).alias("chunk_hash"))
    evidence = triples.evidence_rows(kept.where(~is_class), places, run)
    classes = kept.where(is_class).select(X.to_uri(F.col("subject"), "class").alias("uri"), F.col("subject").alias("label"), F.lit(run).alias("run"))
    metrics = maintenance.qa_metrics(chunks, every, least)
    return Ontology(every, triples.base_ontology_rows(named), evidence, entities.registry(classes), metrics)


@dataclass(frozen=True)
class Promotion:
    """Triples with the reason why they stay out (null if kept), the schema, the types of instances, and the report."""

    decided: DataFrame
    schema: DataFrame
    types: DataFrame
    report: DataFrame


def promote(statements: DataFrame, classes: DataFrame, properties: DataFrame, least: float = 0.6, min_count: int = 1) -> Promotion:
    """Statements (s, p, o, conf) with enough evidence, under a schema of classes (name, parent) and properties.

    properties: (name, domain, range, source_relations). Parents lose their cycles; types are inherited.
    """
    evidence = ontology.collect_evidence(statements)
    decided = ontology.select_candidates(statements.select("s", "p", "o").distinct(), evidence, least, min_count)
    kept = decided.where("reason is null").select("s", "p", "o")
    schema = ontology.apply_schema(classes, properties.select("name", "domain", "range"))
    parents = ontology.remove_cycles(schema.where("p = 'subClassOf'").select("s", "o"))
    types = ontology.type_instances(kept, properties)
    _, inherited = ontology.rdfs_closure(parents.select(F.col("s").alias("child"), F.col("o").alias("parent")), types)
    every = types.select("s", "type").unionByName(inherited.select("s", "type")).distinct()
    steps = {"evidence": evidence, "kept": kept, "left_out": decided.where("reason is not null"), "schema": schema, "types": every, "classes_used": ontology.class_stats(every)}
    return Promotion(decided, schema, every, ontology.promotion_report(steps))


def revert(triples_: DataFrame) -> DataFrame:
    """Triples (s, p, o) without the rows that a promotion declares."""
    return triples_.join(ontology.schema_snapshot(triples_), ["s", "p", "o"], "left_anti")


@dataclass(frozen=True)
class Preview:
    """Triples as they would be written, groups of similar names, suggestions (canonical, variants, n_triples), and how names align with a schema."""

    triples: DataFrame
    groups: DataFrame
    suggestions: DataFrame
    alignment: DataFrame | None


def preview(found: DataFrame, alike: float = 0.85, schema: DataFrame | None = None) -> Preview:
    """What ``confirm`` would write from triples (ord, subject, …), without writing; schema: (kind, name) of what is declared."""
    groups = similar_groups(found, alike)
    suggestions = entities.normalization_suggestions(groups, found)
    alignment = None if schema is None else ontology.align(ontology.schema_candidates(found), schema)
    return Preview(found, groups, suggestions, alignment)


def confirm(seen: Preview, known: DataFrame, chosen: DataFrame, renames: DataFrame) -> DataFrame:
    """``known`` edges with the previewed triples, after the chosen suggestions (canonical) and predicates (name, to)."""
    mapping = seen.groups.join(chosen.select("canonical").distinct(), "canonical", "left_semi").where("entity <> canonical").select(F.col("entity").alias("variant"), "canonical")
    told = ontology.apply_rename(entities.apply_mapping(seen.triples, mapping), renames)
    return triples.merge_edges(known.select(*KEYS), told.select(*KEYS), KEYS)
