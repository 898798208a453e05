"""Triples: parsing replies, filtering, deduplication, inverses, resolution. Columns as in the input, ``ord`` is its order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions import text as X
from corvina.operators.containment import containing

# Relations and their inverses, in two of the shipped variants.
INVERSES = {
    "스승": "제자", "제자": "스승", "부모": "자식", "자식": "부모", "선배": "후배", "후배": "선배", "형": "동생", "동생": "형",
    "언니": "동생", "누나": "동생", "오빠": "동생", "남편": "아내", "아내": "남편",
}
INVERSES_INGEST = {"스승": "제자", "제자": "스승", "부모": "자녀", "자녀": "부모", "선생": "학생", "학생": "선생", "상사": "부하", "부하": "상사"}


def parse_triples(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """(…, subject, predicate, object, confidence) from replies: JSON with triples and properties, fenced or not, else lines with bars."""
    body = F.coalesce(F.nullif(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), F.col(reply))
    kind = "triples array<struct<subject string, predicate string, object string, confidence double>>, properties array<struct<entity string, property string, value string>>"
    j = replies.withColumn("__j", F.when(F.ltrim(body).startswith("{"), F.from_json(body, kind)))
    parsed = F.col("__j.triples").isNotNull() | F.col("__j.properties").isNotNull()
    keep = [c for c in replies.columns if c != reply]

    def row(s: Column, p: Column, o: Column, c: Column) -> Column:
        return F.struct(X.strip_blanks(s).alias("subject"), X.strip_blanks(p).alias("predicate"), X.strip_blanks(o).alias("object"), c.alias("confidence"))

    triples = F.transform("__j.triples", lambda t: row(t["subject"], t["predicate"], t["object"], F.coalesce(t["confidence"], F.lit(0.8))))
    facts = F.transform("__j.properties", lambda t: row(t["entity"], F.concat(F.lit("has_"), t["property"]), t["value"], F.lit(0.9)))
    none = F.array().cast("array<struct<subject:string,predicate:string,object:string,confidence:double>>")
    parts = F.transform(F.split(reply, "\n"), lambda x: F.split(F.regexp_replace(X.strip_blanks(x), r"^[-*] ", ""), r"\|"))
    bars = F.transform(F.filter(parts, lambda p: F.size(p) >= 3), lambda p: row(p[0], p[1], p[2], F.lit(0.7)))
    bars = F.filter(bars, lambda t: (t["subject"] != "") & (t["predicate"] != "") & (t["object"] != "") & (F.length(t["subject"]) < 50) & (F.length(t["predicate"]) < 50))
    found = F.when(parsed, F.concat(F.coalesce(triples, none), F.coalesce(facts, none))).otherwise(bars)
    out = j.select(*keep, F.posexplode(found).alias("pos", "t")).select(*keep, "pos", "t.*")
    return out.where("subject is not null and predicate is not null and object is not null")


def filter_triples(triples: DataFrame, least: float = 0.5) -> DataFrame:
    """Confident enough, with a telling predicate and valid entities."""
    ok = (F.coalesce("confidence", F.lit(1.0)) >= least) & ~X.is_noise_predicate(F.col("predicate"))
    return triples.where(ok & X.is_valid_entity(F.col("subject")) & X.is_valid_entity(F.col("object")))


def dedupe_triples(triples: DataFrame) -> DataFrame:
    """The first row of each triple with normalised ends and trimmed predicate; none may be empty."""
    keys = {"__s": X.normalize_entity(F.col("subject")), "__p": X.strip_blanks(F.col("predicate")), "__o": X.normalize_entity(F.col("object"))}
    rows = triples.withColumns(keys).where("__s <> '' and __p <> '' and __o <> ''")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
    return rows.withColumn("__n", first).where("__n = 1").drop("__n", *keys)


def resolve_duplicates(triples: DataFrame) -> DataFrame:
    """The first row of each exact triple; nulls equal each other."""
    first = F.row_number().over(Window.partitionBy("subject", "predicate", "object").orderBy("ord"))
    return triples.withColumn("__n", first).where("__n = 1").drop("__n")


def postprocess_triples(triples: DataFrame, least: float = 0.5) -> DataFrame:
    kept = filter_triples(triples, least)
    kept = kept.withColumns({"subject": X.normalize_entity(F.col("subject")), "object": X.normalize_entity(F.col("object"))})
    return dedupe_triples(kept)


def add_inverse(triples: DataFrame, inverses: dict[str, str] = INVERSES, default_prefix: str | None = None) -> DataFrame:
    """Rows and their inverses, flagged; with a prefix, predicates outside the map get an inverse too."""
    mapped = F.create_map(*[F.lit(x) for pair in inverses.items() for x in pair])
    other = F.concat(F.lit(default_prefix), F.col("predicate")) if default_prefix else F.lit(None).cast("string")
    own = triples.withColumn("is_inverse", F.coalesce(F.col("is_inverse"), F.lit(False)) if "is_inverse" in triples.columns else F.lit(False))
    turned = own.where(~F.col("is_inverse")).withColumn("__p", F.coalesce(F.try_element_at(mapped, F.col("predicate")), other)).where("__p is not null")
    turned = turned.withColumns({"subject": F.col("object"), "object": F.col("subject"), "predicate": F.col("__p"), "is_inverse": F.lit(True)}).drop("__p")
    return own.unionByName(turned)


def lookup_types(triples: DataFrame, dictionary: DataFrame) -> DataFrame:
    """subject_type and object_type by canonical name, else by variant; dictionary: (canonical, type, variants)."""
    names = dictionary.select(F.col("canonical").alias("name"), "type", F.lit(0).alias("o"))
    names = names.unionByName(dictionary.select(F.explode("variants").alias("name"), "type", F.lit(1).alias("o")))
    best = names.groupBy("name").agg(F.min(F.struct("o", "type"))["type"].alias("type"))
    out = triples
    for end in ("subject", "object"):
        out = out.join(best.select(F.col("name").alias(end), F.col("type").alias(f"{end}_type")), end, "left")
    return out


def link_entity_chunks(triples: DataFrame, mentions: DataFrame) -> DataFrame:
    """Triples without a source get the first chunk of their subject; mentions: (entity, chunk_id)."""
    first = mentions.groupBy(F.col("entity").alias("subject")).agg(F.min("chunk_id").alias("__c"))
    return triples.join(first, "subject", "left").withColumn("source_node_id", F.coalesce("source_node_id", "__c")).drop("__c")


def filter_candidates(candidates: DataFrame, least: float = 0.5) -> DataFrame:
    return candidates.where(F.col("confidence") >= least)


def manual_triples(selection: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    return selection.withColumns({"doc_id": F.concat(F.lit("manual_"), F.col(chunk)), "confidence": F.coalesce("confidence", F.lit(0.8))})


def to_ntriples(triples: DataFrame) -> DataFrame:
    """(g, s, p, o) rows of each triple: the edge, labels, and the statement with its source; rows with an empty part go."""
    base = "urn:kg:"
    s, p, o = (F.regexp_replace(X.strip_blanks(F.col(c)), "[^a-zA-Z0-9_가-힣Ѐ-ӿ]+", "_") for c in ("subject", "predicate", "object"))
    rows = triples.withColumns({"__s": s, "__p": p, "__o": o}).where("__s <> '' and __p <> '' and __o <> ''")
    su, pu, ou = F.concat(F.lit(base + "inst/"), "__s"), F.concat(F.lit(base + "rel/"), "__p"), F.concat(F.lit(base + "inst/"), "__o")
    st = F.concat(F.lit(base + "stmt/"), F.substring(F.sha2(F.concat_ws("|", su, pu, ou), 256), 1, 16))

    def row(a, b, c):
        return F.struct(a.alias("s"), (F.lit(b) if isinstance(b, str) else b).alias("p"), c.cast("string").alias("o"))

    listed = F.array(
        row(su, pu, ou), row(su, "label", F.col("subject")), row(pu, "label", F.col("predicate")), row(ou, "label", F.col("object")), row(st, "type", F.lit("Statement")),
        row(st, "subject", su), row(st, "predicate", pu), row(st, "object", ou), row(st, "sourceNodeId", F.col("source_node_id")), row(st, "docId", F.col("doc_id")),
        row(st, "confidence", F.round("confidence", 4)),
    )
    return rows.select(F.concat(F.lit("urn:doc:"), "doc_id").alias("g"), F.inline(listed)).where("o is not null").distinct()


def merge_edges(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Target and those new rows whose keys it lacks; empty ends go, repeats in the new rows too."""
    good = new.where("subject <> '' and predicate <> '' and object <> ''").dropDuplicates(keys)
    return target.unionByName(good.join(target.select(*keys).distinct(), keys, "left_anti"))


def structured_to_triples(docs: DataFrame, body: str = "body", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, subject, predicate, object) of flat JSON objects: identity from id, else name; type rows; fields as facts.

    A field whose text is the identity of another record is a reference (``is_reference``).
    """
    fields = docs.select(id_col, F.from_json(body, "map<string,string>").alias("m")).where("m is not null")
    identity = F.coalesce(*[F.nullif(F.try_element_at("m", F.lit(k)), F.lit("")) for k in ("id", "@id", "uuid", "_id", "key", "name", "title", "label")], F.concat(F.lit("anonymous_"), F.col(id_col).cast("string")))
    kind = F.coalesce(*[F.nullif(F.try_element_at("m", F.lit(k)), F.lit("")) for k in ("type", "@type", "kind", "class")], F.lit("Entity"))
    rows = fields.select(id_col, identity.alias("subject"), X.class_from_key(kind, False).alias("type"), F.explode("m").alias("k", "v"))
    facts = rows.where(~F.col("k").isin("id", "@id", "uuid", "_id", "key", "type", "@type", "kind", "class") & F.col("v").isNotNull())
    facts = facts.select(id_col, "subject", F.when(F.col("k").isin("name", "title", "label"), "label").otherwise(F.col("k")).alias("predicate"), F.col("v").alias("object"))
    types = rows.select(id_col, "subject", F.lit("_type").alias("predicate"), F.col("type").alias("object")).distinct()
    known = rows.select(F.col("subject").alias("object")).distinct().withColumn("is_reference", F.lit(True))
    return facts.unionByName(types).join(known, "object", "left").select(id_col, "subject", "predicate", "object", F.coalesce("is_reference", F.lit(False)).alias("is_reference"))


def attach_section_offsets(triples: DataFrame, sections: DataFrame) -> DataFrame:
    return triples.join(sections.select("section_id", F.col("start").alias("source_start"), F.col("end").alias("source_end")), "section_id", "left")


def evidence_match(triples: DataFrame, chunks: DataFrame, most: int = 3) -> DataFrame:
    """(ord, chunk_id): chunks of the same document that name the subject or object, else its first ones, at most ``most``.

    triples: (ord, doc_id, subject, object), one row for each ord; chunks: (doc_id, chunk_id, content). A triple with a null
    end takes only chunks that name the other one.
    """
    ends = triples.select("doc_id", F.explode(F.array(F.lower("subject"), F.lower("object"))).alias("pattern"))
    found = containing(ends.select(F.col("doc_id").alias("scope"), "pattern"), chunks.select(F.col("doc_id").alias("scope"), F.col("chunk_id").alias("id"), F.lower("content").alias("text")))
    found = _first(found, ["scope", "pattern"], "id", most).select(F.col("scope").alias("doc_id"), F.col("pattern").alias("end"), F.col("first").alias("ids"))
    told = _first(chunks.where("content is not null"), ["doc_id"], "chunk_id", most).withColumnRenamed("first", "told")  # these hold the empty name
    every = _first(chunks, ["doc_id"], "chunk_id", most).withColumnRenamed("first", "every").join(told, "doc_id")
    rows = triples.join(every, "doc_id")
    for end in ("subject", "object"):
        own = found.select("doc_id", F.col("end").alias(f"__{end}"), F.col("ids").alias(f"{end}_ids"))
        rows = rows.withColumn(f"__{end}", F.lower(end)).join(own, ["doc_id", f"__{end}"], "left")
        none = F.slice("told", 1, 0)
        rows = rows.withColumn(f"{end}_ids", F.when(F.col(f"__{end}") == "", F.col("told")).otherwise(F.coalesce(f"{end}_ids", none)))
    both = F.array_union("subject_ids", "object_ids")
    whole = F.col("subject").isNotNull() & F.col("object").isNotNull()
    chosen = F.when(F.size(both) > 0, F.slice(F.array_sort(both), 1, most)).when(whole, F.col("every"))
    return rows.select("ord", F.explode(chosen).alias("chunk_id"))


def _first(rows: DataFrame, keys: list[str], value: str, most: int) -> DataFrame:
    """(keys, first): the smallest values of each group, sorted."""
    place = Window.partitionBy(*keys).orderBy(value)
    few = rows.select(*keys, value).withColumn("__n", F.row_number().over(place)).where(F.col("__n") <= most)
    return few.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("first"))


def base_ontology_rows(candidates: DataFrame) -> DataFrame:
    """(s, p, o) declarations of candidates (kind, name, parent, domain, range, comment)."""
    kinds = F.create_map(*[F.lit(x) for x in ("class", "Class", "relation", "ObjectProperty", "property", "DatatypeProperty", "instance", "NamedIndividual")])
    facts = [("type", kinds[F.col("kind")]), ("label", F.col("name")), ("subClassOf", F.col("parent")), ("domain", F.col("domain")), ("range", F.col("range")), ("comment", F.col("comment"))]
    listed = F.array(*[F.struct(F.col("name").alias("s"), F.lit(p).alias("p"), o.alias("o")) for p, o in facts])
    return candidates.select(F.inline(listed)).where("o is not null").distinct()


# Words that mark a type as a class.
ABSTRACT_WORDS = ["class", "concept", "type", "category", "abstract", "개념", "분류"]


def candidate_rows(replies: DataFrame, words: list[str] = ABSTRACT_WORDS) -> DataFrame:
    """(kind, name): class rows for types with one of the words, else instance rows; replies: (name, type)."""
    kind = F.when(F.lower("type").rlike("|".join(words)), "class").otherwise("instance")
    return replies.select(kind.alias("kind"), "name").distinct()


# Sentence patterns of classes, relations and properties, and their confidences.
CLASS_PATTERNS = [
    r"(.{2,10})은(?:는)?\s+(.{2,15})(?:이다|이라고 한다|를 말한다)",
    r"(.{2,10})란\s+(.{5,30})(?:을|를)?\s*(?:말한다|의미한다)",
]
RELATION_PATTERNS = [
    r"(.{2,15})(?:은|는|이|가)\s+(.{2,15})(?:을|를|에게|와|과)\s+(.{2,10})(?:한다|했다|하였다)",
    r"(.{2,15})의\s+(.{2,10})(?:은|는)\s+(.{2,15})",
]
PROPERTY_PATTERNS = [r"(.{2,15})의\s+(.{2,10})(?:은|는|이)\s+(.{2,20})(?:이다|이었다)"]
CLASS_CONFIDENCE, OTHER_CONFIDENCE = 0.7, 0.6


def candidate_patterns(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(chunk_id, kind, subject, predicate, object, is_literal, confidence, source_text) of every match of a pattern.

    A class has its name as subject and its description as object; relations and properties are triples.
    """
    rules = [("class", p, (1, None, 2)) for p in CLASS_PATTERNS] + [("relation", p, (1, 3, 2)) for p in RELATION_PATTERNS] + [("property", p, (1, 2, 3)) for p in PROPERTY_PATTERNS]

    def matches(kind: str, pattern: str, places: tuple) -> Column:
        groups = [F.regexp_extract_all(text_col, F.lit(pattern), F.lit(k)) for k in range(4 if places[1] else 3)]

        def row(i: Column) -> Column:
            s, p, o = (X.strip_blanks(F.get(groups[k], i)) if k else F.lit(None).cast("string") for k in places)
            confidence = F.lit(CLASS_CONFIDENCE if kind == "class" else OTHER_CONFIDENCE)
            literal = F.lit(kind == "property")
            names = ("kind", "subject", "predicate", "object", "is_literal", "confidence", "source_text")
            return F.struct(*[c.alias(n) for c, n in zip((F.lit(kind), s, p, o, literal, confidence, F.get(groups[0], i)), names, strict=True)])

        spots = F.filter(F.sequence(F.lit(0), F.size(groups[0])), lambda i: i < F.size(groups[0]))
        return F.transform(spots, row)

    found = [matches(*rule) for rule in rules]
    return chunks.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("chunk_id"), F.inline(F.concat(*found)))


def evidence_rows(triples: DataFrame, chunks: DataFrame, run: str) -> DataFrame:
    """(g, s, p, o, confidence, evidence_text, source, chunk_hash, run_id): each triple with where it was found.

    triples: (chunk_id, subject, predicate, object, is_literal, confidence, source_text); chunks: (chunk_id, graph, uri,
    chunk_hash). Literals keep their text, and their predicates are properties.
    """
    p = F.when(F.col("is_literal"), X.to_uri(F.col("predicate"), "property")).otherwise(X.to_uri(F.col("predicate"), "relation"))
    o = F.when(F.col("is_literal"), F.col("object")).otherwise(X.to_uri(F.col("object"), "instance"))
    return triples.join(chunks.select("chunk_id", F.col("graph").alias("g"), F.col("uri").alias("source"), "chunk_hash"), "chunk_id").select(
        "g", X.to_uri(F.col("subject"), "instance").alias("s"), p.alias("p"), o.alias("o"), "confidence", F.col("source_text").alias("evidence_text"), "source", "chunk_hash", F.lit(run).alias("run_id")
    )
