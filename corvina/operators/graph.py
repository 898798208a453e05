"""Reads over an edge table (subject, predicate, object, …): neighbours, paths, inference, views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions import text as X
from corvina.operators.containment import containing
from corvina.operators.entities import link_candidates
from corvina.session import saved

# Predicates that tell where a triple comes from.
PROVENANCE = ["MENTIONED_IN", "sourceNodeId", "docId", "confidence"]


def _contains_pairs(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, node), case-insensitive, where one contains the other; nodes of one character don't count."""
    a = names.select("name", F.lower("name").alias("a")).where("a <> ''").distinct()
    b = nodes.select("node", F.lower("node").alias("b")).where("length(b) > 1").distinct()

    def within(x, y, text):
        return containing(x.select(F.lit(0).alias("scope"), F.col(x.columns[1]).alias("pattern")), y.select(F.lit(0).alias("scope"), F.col(y.columns[0]).alias("id"), F.col(text).alias("text")))

    ab = within(a, b, "b").select(F.col("pattern").alias("a"), F.col("id").alias("node")).join(a, "a")
    ba = within(b, a, "a").select(F.col("pattern").alias("b"), F.col("id").alias("name")).join(b, "b")
    return ab.select("name", "node").union(ba.select("name", "node")).distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("subject", "object")).alias("node")).distinct()


def neighbors(edges: DataFrame, names: DataFrame, most: int | None = 100) -> DataFrame:
    """(name, subject, predicate, object), distinct: edges with an end that contains the name or is contained in it."""
    own = edges.where(~F.col("predicate").isin(PROVENANCE))
    pairs = _contains_pairs(names, nodes_of(own))
    hits = None
    for end in ("subject", "object"):
        part = own.join(pairs.withColumnRenamed("node", end), end).select("name", "subject", "predicate", "object")
        hits = part if hits is None else hits.unionByName(part)
    hits = hits.distinct()
    if most is None:
        return hits
    place = Window.partitionBy("name").orderBy("subject", "predicate", "object")
    return hits.withColumn("n", F.row_number().over(place)).where(F.col("n") <= most).drop("n")


def relations_between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(e1, e2, subject, predicate, object): edges in either direction whose ends match the pair's names in part."""
    names = pairs.select(F.explode(F.array("e1", "e2")).alias("name")).distinct()
    near = _contains_pairs(names, nodes_of(edges))
    s, o = near.select(F.col("name").alias("sn"), F.col("node").alias("subject")), near.select(F.col("name").alias("on"), F.col("node").alias("object"))
    hits = edges.join(s, "subject").join(o, "object").select("subject", "predicate", "object", "sn", "on")
    ahead = hits.join(pairs, (F.col("sn") == F.col("e1")) & (F.col("on") == F.col("e2")))
    back = hits.join(pairs, (F.col("sn") == F.col("e2")) & (F.col("on") == F.col("e1")))
    cols = ["e1", "e2", "subject", "predicate", "object"]
    return ahead.select(*cols).union(back.select(*cols)).distinct()


def relevance_gate(queries: DataFrame, triples: DataFrame) -> DataFrame:
    """Triples (query_id, subject, predicate, object) of the queries (query_id, keywords) without keywords or with one that
    occurs in a predicate or object of theirs."""
    q = triples.join(queries, "query_id")
    hay = F.lower(F.concat_ws(" ", "predicate", "object"))
    passed = F.bool_or((F.size("keywords") == 0) | F.exists("keywords", lambda k: hay.contains(F.lower(k))))
    ok = q.groupBy("query_id").agg(passed.alias("ok")).where("ok").select("query_id")
    return triples.join(ok, "query_id", "left_semi")


def triples_for_entities(edges: DataFrame, focus: DataFrame, most: int = 30) -> DataFrame:
    """(name, subject, predicate, object, source_node_id): the first edges with an end equal to the name."""
    hits = None
    for end in ("subject", "object"):
        part = edges.join(focus.select("name", F.col("name").alias(end)), end).select("name", "subject", "predicate", "object", "source_node_id")
        hits = part if hits is None else hits.unionByName(part)
    place = Window.partitionBy("name").orderBy("subject", "predicate", "object", "source_node_id")
    return hits.distinct().withColumn("n", F.row_number().over(place)).where(F.col("n") <= most).drop("n")


def source_chunks(statements: DataFrame, names: DataFrame) -> DataFrame:
    ends = statements.select("source_node_id", F.explode(F.array("subject", "object")).alias("name"))
    return ends.join(names, "name", "left_semi").select("source_node_id").distinct()


def predicates_of(edges: DataFrame, names: DataFrame) -> DataFrame:
    own = edges.where(~F.col("predicate").isin([*PROVENANCE, "type", "label"]))
    out = own.join(names.select(F.col("name").alias("subject")), "subject").select(F.col("subject").alias("name"), "predicate", F.lit("out").alias("direction"))
    back = own.join(names.select(F.col("name").alias("object")), "object").select(F.col("object").alias("name"), "predicate", F.lit("in").alias("direction"))
    return out.union(back).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    ab = edges.select(F.col("subject").alias("a"), F.col("object").alias("b"))
    return ab.union(edges.select("object", "subject")).distinct()


def expand_entities(edges: DataFrame, names: DataFrame, most: int = 10) -> DataFrame:
    """(name, other): the first neighbours of each name, names asked for left out."""
    hits = names.join(both_ways(edges), F.col("name") == F.col("a")).select("name", F.col("b").alias("other")).distinct()
    hits = hits.join(names.select(F.col("name").alias("other")), "other", "left_anti")
    return hits.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("other"))).where(F.col("n") <= most).select("name", "other")


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """(seed, node, hop): nodes within so many edges of each seed (column ``name``), at their least distance."""
    pairs = both_ways(edges)
    seen = saved(seeds.select(F.col("name").alias("seed"), F.col("name").alias("node"), F.lit(0).alias("hop")).distinct(), "hops")
    last = seen
    for hop in range(1, hops + 1):
        step = last.join(pairs, F.col("node") == F.col("a")).select("seed", F.col("b").alias("node")).distinct()
        last = saved(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop)), "hops")
        seen = seen.unionByName(last)
    return seen


def path_pattern(edges: DataFrame, p1: str, p2: str) -> DataFrame:
    a = edges.where(F.col("predicate") == p1).select(F.col("subject").alias("a"), F.col("object").alias("b"))
    b = edges.where(F.col("predicate") == p2).select(F.col("subject").alias("b"), F.col("object").alias("c"))
    return a.join(b, "b").select("a", "b", "c").distinct()


def infer_two_hop(edges: DataFrame, rules: DataFrame, scope: str | None = None) -> DataFrame:
    """(subject, predicate, object, rule): new edges a-c from a-p1-b-p2-c, ends differ; rules: (rule, p1, p2, inferred).

    ``scope`` names a column that both edges must share, such as the document.
    """
    more = [F.col(scope).alias("g")] if scope else [F.lit(0).alias("g")]
    a = edges.select(F.col("subject").alias("s"), F.col("predicate").alias("p1"), F.col("object").alias("m"), *more)
    b = edges.select(F.col("subject").alias("m"), F.col("predicate").alias("p2"), F.col("object").alias("o"), *more)
    left = a.join(F.broadcast(rules), "p1")  # few predicates have nearly all edges
    found = left.join(b, ["m", "p2", "g"]).where("s <> o").select(F.col("s").alias("subject"), F.col("inferred").alias("predicate"), F.col("o").alias("object"), "rule").distinct()
    return found.join(edges.select("subject", "predicate", "object").distinct(), ["subject", "predicate", "object"], "left_anti")


# Parts of the names of bookkeeping predicates, and names of the predicate that gives a type.
SYSTEM_PREDICATES, TYPE_PREDICATES = "rdf-syntax-ns#|rag.local/meta|rag.local/stmt", ["type", "a", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"]
#: How many names of each kind a live schema lists.
SCHEMA_SIZES = {"predicate": 200, "class": 20, "relation": 100, "label": 50}


def live_schema(edges: DataFrame, sizes: dict[str, int] = SCHEMA_SIZES) -> DataFrame:
    """(kind, name, n, rank): the commonest predicates, classes, relation types and node labels of the edges, from one scan.

    edges: (subject, predicate, object), and ``is_literal``, ``subject_type``, ``object_type`` where they are known. Classes are
    the objects of type statements; relation types are predicates between entities in the property graph's form; labels are
    the types of ends, Entity where none is given. Every list is cut at its size (ties by name).
    """
    p = F.col("predicate")
    is_type = p.isin(TYPE_PREDICATES)
    literal = F.coalesce("is_literal", F.lit(False)) if "is_literal" in edges.columns else F.lit(False)
    short = F.when(p.contains("/rel/"), F.concat(F.lit("rel:"), F.substring_index(p, "/rel/", -1))).otherwise(F.substring_index(p, "#", -1))
    o = F.col("object")
    named = F.when(o.contains("/class/"), F.concat(F.lit("class:"), F.substring_index(o, "/class/", -1))).otherwise(F.substring_index(o, "/", -1))
    kind = F.upper(F.regexp_replace(p, "[^a-zA-Z0-9_가-힣]", "_"))
    labels = [F.coalesce(c, F.lit("Entity")) if c in edges.columns else F.lit("Entity") for c in ("subject_type", "object_type")]
    system = F.lower(p).rlike(SYSTEM_PREDICATES)
    found = F.array(
        F.struct(F.lit("predicate").alias("kind"), F.when(~system, short).alias("name")), F.struct(F.lit("class").alias("kind"), F.when(is_type & ~F.lower(o).contains("rdf-syntax-ns#"), named).alias("name")),
        F.struct(F.lit("relation").alias("kind"), F.when(~is_type & ~system & ~literal, F.when(kind == "", "RELATED_TO").otherwise(kind)).alias("name")),
        F.struct(F.lit("label").alias("kind"), F.when(~is_type, labels[0]).alias("name")), F.struct(F.lit("label").alias("kind"), F.when(~is_type & ~literal, labels[1]).alias("name")),
    )
    counts = edges.select(F.inline(found)).where("name is not null").groupBy("kind", "name").agg(F.count("*").alias("n"))
    most = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "name"))
    return counts.withColumn("rank", place).where(F.col("rank") <= most[F.col("kind")])


def unknown_relations(referenced: DataFrame, schema: DataFrame) -> DataFrame:
    """Names referenced that the schema lacks, by lower-cased local names; none where the schema is empty."""
    known = schema.select(F.lower(X.local_name(F.col("predicate"))).alias("key")).distinct()
    some = known.agg((F.count("*") > 0).alias("some"))
    asked = referenced.select("name", F.lower(X.local_name(F.col("name"))).alias("key")).join(F.broadcast(some)).where("some")
    return asked.join(known, "key", "left_anti").select("name").distinct()


def list_triples(
    edges: DataFrame, subject: str = "", predicate: str = "", object: str = "", skip: int = 0, limit: int = 50, sort: Sequence[tuple[str, str]] = (), docs: DataFrame | None = None,
    chunks: DataFrame | None = None, text: int = 500,
) -> tuple[DataFrame, DataFrame]:
    """A page of the triples that contain the texts asked for, in order, with ``place`` (from 0); and one row, their number.

    ``sort`` names columns with asc or desc; what is equal in them comes by subject, predicate, object and ord. With docs
    (doc_id, filename) and chunks (chunk_id, content) the page's rows get the file's name and the first characters of the
    chunk's text, null where there is none.

    A page far from the start sorts no more than the ranges that it lies in: rows are dealt to ranges of the sort keys,
    ranges are counted (a number for each), and only those that hold the page are sorted.
    """
    hits = edges
    for column, asked in (("subject", subject), ("predicate", predicate), ("object", object)):
        if asked:
            hits = hits.where(F.lower(column).contains(asked.lower()))
    named = {c: d.lower() for c, d in sort if c in ("subject", "predicate", "object", "confidence", "doc_id") and c in edges.columns}
    keys = [F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_first() for c, d in named.items()]
    keys += [F.col(c).asc_nulls_first() for c in ("subject", "predicate", "object", "ord") if c not in named]
    ranged = saved(hits.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = dict(ranged.groupBy("__range").count().collect())  # no more than ranges
    wanted, before, start = [], 0, None
    for r in sorted(counts):
        if before < skip + limit and before + counts[r] > skip:
            wanted.append(r)
            start = before if start is None else start
        before += counts[r]
    start = start or 0
    page = ranged.where(F.col("__range").isin(wanted)).orderBy(*keys).offset(max(0, skip - start)).limit(limit).drop("__range")
    page = page.withColumn("place", F.row_number().over(Window.orderBy(*keys)) + F.lit(skip - 1))  # a page's rows
    if docs is not None:
        page = page.join(docs.select("doc_id", "filename").dropDuplicates(["doc_id"]), "doc_id", "left")
    if chunks is not None:
        texts = chunks.select(F.col("chunk_id").alias("source_node_id"), F.substring("content", 1, text).alias("chunk_text")).dropDuplicates(["source_node_id"])
        page = page.join(texts, "source_node_id", "left")
    return page, ranged.agg(F.count("*").alias("total"))


def clickable_entities(names: DataFrame, edges: DataFrame) -> DataFrame:
    """Names equal to a node, or of two characters or more and part of one or the other way round (underscores as blanks)."""
    clean = F.lower(X.strip_blanks(F.replace("x", F.lit("_"), F.lit(" "))))
    n = saved(names.select("name", F.col("name").alias("x")).select("name", clean.alias("key")), "names")
    nodes = saved(nodes_of(edges).select(F.col("node").alias("x")).select(clean.alias("node")).distinct(), "nodes")  # read three times
    equal = n.join(nodes, n.key == nodes.node, "left_semi").select("name")
    part = _contains_pairs(n.where(F.length("key") > 1).select(F.col("key").alias("name")), nodes).select(F.col("name").alias("key")).distinct()
    return equal.union(n.join(part, "key", "left_semi").select("name")).distinct()


def resolve_mentions(mentions: DataFrame, nodes: DataFrame, most: int = 2) -> DataFrame:
    """(query_id, node, score): the best-linked nodes of each query's mentions (query_id, token), the first two."""
    best = link_candidates(mentions.select("token").distinct(), nodes.select(F.col("node").alias("candidate")))
    rows = mentions.join(best, "token").groupBy("query_id", F.col("candidate").alias("node")).agg(F.max("score").alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    return rows.withColumn("n", F.row_number().over(place)).where(F.col("n") <= most).drop("n")


def viewer(edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and links around exact names."""
    links = triples_for_entities(edges.withColumn("source_node_id", F.lit(None).cast("string")), names, 50).select("subject", "predicate", "object").distinct()
    return nodes_of(links), links


# Particles after an object, and after a subject.
OBJECT_PARTICLES, SUBJECT_PARTICLES = ["을", "를"], ["의", "이", "가"]


def classify_pattern(queries: DataFrame, resolved: DataFrame) -> DataFrame:
    """(query_id, pattern): what is asked for beside the entities that were resolved.

    resolved: (query_id, name, role). One entity is the object where its role says so, or without a role the particle
    after it, else the subject; with two the relation is asked for; other queries have no pattern.
    """
    few = resolved.groupBy("query_id").agg(F.count("*").alias("n"), F.min(F.struct("name", "role")).alias("e")).select("query_id", "n", "e.name", "e.role")
    after = F.substr("query_text", F.instr("query_text", F.col("name")) + F.length("name"), F.lit(1))
    by_particle = (F.instr("query_text", F.col("name")) > 0) & after.isin(OBJECT_PARTICLES)
    is_object = F.when(F.col("role").isin("object", "subject"), F.col("role") == "object").otherwise(by_particle)
    pattern = F.when(F.col("n") == 2, "relation_unknown").when((F.col("n") == 1) & is_object, "subject_unknown").when(F.col("n") == 1, "object_unknown")
    return queries.join(few, "query_id", "left").select("query_id", pattern.alias("pattern"))


def entity_guided_query(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, query_text) with the names of the entities found, by alphabet, after the text."""
    names = entities.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("name")), " ").alias("names"))
    return queries.join(names, "query_id", "left").select("query_id", F.concat_ws(" ", "query_text", "names").alias("query_text"))


def graph_search(edges: DataFrame, queries: DataFrame, entities: DataFrame, hops: bool = False, most: int = 30, score: float = 1.0) -> DataFrame:
    """(query_id, source_node_id, n_triples, score): the chunks that tell about each query's entities.

    queries: (query_id, keywords); entities: (query_id, name). With ``hops`` the entities' first neighbours count too. Of
    every entity the first ``most`` triples are taken; a query's triples go where none matches its keywords. A query
    without a hit keeps one row without a chunk.
    """
    wanted = entities.select("query_id", "name").distinct()
    if hops:
        near = expand_entities(edges, wanted.select("name").distinct())
        wanted = wanted.unionByName(wanted.join(near, "name").select("query_id", F.col("other").alias("name"))).distinct()
    told = triples_for_entities(edges, wanted.select("name").distinct(), most).join(wanted, "name").drop("name").distinct()
    passed = relevance_gate(queries.select("query_id", "keywords"), told)
    chunks = passed.groupBy("query_id", "source_node_id").agg(F.count("*").alias("n_triples")).withColumn("score", F.lit(score))
    return queries.select("query_id").join(chunks, "query_id", "left").withColumns({"n_triples": F.coalesce("n_triples", F.lit(0)), "score": F.coalesce("score", F.lit(0.0))})
