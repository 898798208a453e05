"""Promotion of a triple graph into a schema with typed instances."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corvina.functions import text as X
from corvina.operators.similar import similar_between
from corvina.session import saved

# Predicates that always pass the selection.
STRUCTURAL = ["type", "label", "comment", "domain", "range", "subClassOf"]


def collect_evidence(statements: DataFrame) -> DataFrame:
    """(s, p, o, n, confidence): how many statements a triple has, and the largest confidence that can be read."""
    return statements.groupBy("s", "p", "o").agg(F.count("*").alias("n"), F.max(F.expr("try_cast(conf as double)")).alias("confidence"))


def select_candidates(triples: DataFrame, evidence: DataFrame, least: float = 0.6, min_count: int = 1) -> DataFrame:
    """Triples (s, p, o) with ``reason``, null for those kept: structural ones, and those with enough evidence.

    A triple without evidence counts as one statement of confidence 1.
    """
    rows = triples.join(evidence, ["s", "p", "o"], "left").withColumns({"n": F.coalesce("n", F.lit(1)), "confidence": F.coalesce("confidence", F.lit(1.0))})
    low = F.when(F.col("confidence") < least, F.format_string(f"Low Confidence (%.2f < {least})", "confidence"))
    few = F.when(F.col("n") < min_count, F.format_string(f"Insufficient Evidence (%d < {min_count})", "n"))
    reason = F.nullif(F.concat_ws(", ", low, few), F.lit(""))
    return rows.withColumn("reason", F.when(~F.col("p").isin(STRUCTURAL), reason))


def relation_profile(triples: DataFrame, top: int = 60, examples: int = 5) -> DataFrame:
    """(p, n, examples): the commonest relations, each with example pairs of different subjects first."""
    counts = triples.groupBy("p").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p").limit(top)
    per_subject = F.row_number().over(Window.partitionBy("p", "s").orderBy("o"))
    spread = triples.select("p", "s", "o").withColumn("k", per_subject)
    first = spread.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("k", "s", "o"))).where(F.col("r") <= examples)
    shown = first.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("r", "s", "o"))).alias("l"))
    return counts.join(shown, "p").select("p", "n", F.transform("l", lambda x: F.concat(x["s"], F.lit(" -> "), x["o"])).alias("examples"))


def concept_frequency(triples: DataFrame, top: int = 80) -> DataFrame:
    ends = triples.select(F.explode(F.array("s", "o")).alias("concept"))
    return ends.groupBy("concept").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "concept").limit(top)


def label_of(uris: DataFrame, labels: DataFrame) -> DataFrame:
    """(uri, label): the first label by alphabet, else the local name."""
    first = labels.groupBy("uri").agg(F.min("label").alias("label"))
    return uris.join(first, "uri", "left").select("uri", F.coalesce("label", X.local_name(F.col("uri"))).alias("label"))


def apply_schema(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """(s, p, o) declarations; domains, ranges and parents only where both classes are known.

    classes: (name, parent); properties: (name, domain, range).
    """
    known = classes.select(F.col("name").alias("k")).distinct()
    rows = classes.select(F.col("name").alias("s"), F.lit("type").alias("p"), F.lit("Class").alias("o"))
    rows = rows.unionByName(classes.join(known, F.col("parent") == F.col("k")).select(F.col("name").alias("s"), F.lit("subClassOf").alias("p"), F.col("parent").alias("o")))
    rows = rows.unionByName(properties.select(F.col("name").alias("s"), F.lit("type").alias("p"), F.lit("ObjectProperty").alias("o")))
    for side in ("domain", "range"):
        rows = rows.unionByName(properties.join(known, F.col(side) == F.col("k")).select(F.col("name").alias("s"), F.lit(side).alias("p"), F.col(side).alias("o")))
    return rows.distinct()


def type_instances(triples: DataFrame, properties: DataFrame) -> DataFrame:
    """(s, type): ends of relations get the domain or range of the property that names them among its sources, else itself."""
    sources = properties.select(F.explode(F.when(F.size("source_relations") > 0, F.col("source_relations")).otherwise(F.array("name"))).alias("p"), "domain", "range")
    rows = triples.withColumn("p", X.local_name(F.col("p"))).join(F.broadcast(sources), "p")  # few relations have nearly all triples
    ends = rows.select(F.explode(F.array(F.struct(F.col("s").alias("s"), F.col("domain").alias("type")), F.struct(F.col("o").alias("s"), F.col("range").alias("type")))).alias("e"))
    return ends.select("e.*").where("type is not null").distinct()


def class_stats(types: DataFrame) -> DataFrame:
    return types.groupBy("type").agg(F.countDistinct("s").alias("n"), F.min("s").alias("first"))


def class_instance_lists(types: DataFrame) -> DataFrame:
    """(type, n, instances): every class's instances, sorted. One row holds a class as a whole; ``class_instances`` pages."""
    lists = types.select("type", "s").distinct().groupBy("type").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("s")).alias("instances"))
    return lists


def remove_cycles(hierarchy: DataFrame) -> DataFrame:
    """(s, o) without self loops and without both directions of two-cycles."""
    own = hierarchy.where("s <> o")
    return own.join(own.select(F.col("o").alias("s"), F.col("s").alias("o")), ["s", "o"], "left_anti")


def constraint_counts(triples: DataFrame) -> DataFrame:
    props = triples.where("p = 'type' and o = 'ObjectProperty'").select("s").distinct()
    rows = triples.where(F.col("p").isin("domain", "range")).join(props, "s", "left_semi")
    return rows.groupBy("p").agg(F.countDistinct("s").alias("n"))


def strip_evidence(triples: DataFrame) -> DataFrame:
    return triples.where(~F.col("s").contains("/stmt/") & ~F.col("p").isin("sourceNodeId", "docId", "confidence"))


def rdfs_closure(subclass: DataFrame, types: DataFrame, max_rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    """The transitive closure of (child, parent), and types (s, type) inherited along it.

    Paths double in length each round, so the number of rounds is logarithmic in the depth.
    """
    closed = saved(subclass.select("child", "parent").where("child <> parent").distinct(), "closure")
    n = closed.count()
    for _ in range(max_rounds):
        step = closed.join(closed.select(F.col("child").alias("parent"), F.col("parent").alias("up")), "parent").select("child", F.col("up").alias("parent"))
        closed = saved(closed.unionByName(step.where("child <> parent")).distinct(), "closure")
        more = closed.count()
        if more == n:
            break
        n = more
    inherited = types.join(closed, types.type == closed.child).select("s", F.col("parent").alias("type"))
    return closed, types.select("s", "type").unionByName(inherited).distinct()


def evolve_tbox(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(class, n, properties): known classes keep their counts; property sets are united."""
    rows = existing.select("class", "n", "properties", F.lit(0).alias("age")).unionByName(new.select("class", "n", "properties", F.lit(1).alias("age")))
    g = rows.groupBy("class").agg(F.min(F.struct("age", "n"))["n"].alias("n"), F.flatten(F.collect_list("properties")).alias("p"))
    return g.select("class", "n", F.array_sort(F.array_distinct("p")).alias("properties"))


def schema_candidates(triples: DataFrame) -> DataFrame:
    """(kind, name): classes other than Entity and properties other than label and _type that the triples use."""
    classes = triples.select(F.explode(F.array("subject_type", "object_type")).alias("name")).where("name is not null and name <> 'Entity'").select(F.lit("class").alias("kind"), "name")
    props = triples.where(~F.col("predicate").isin("label", "_type")).select(F.lit("property").alias("kind"), F.col("predicate").alias("name"))
    return classes.union(props).distinct()


def align_exact(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """(kind, name, existing, status) by equal names, whatever the case; the rest is new."""
    known = existing.groupBy("kind", F.lower("name").alias("key")).agg(F.min("name").alias("existing"))
    rows = candidates.withColumn("key", F.lower("name")).join(known, ["kind", "key"], "left")
    return rows.select("kind", "name", "existing", F.when(F.col("existing").isNotNull(), "matched").otherwise("new").alias("status"))


@F.pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks over all characters, of lower-cased strings: longest block first, then left and right of it."""
    one = difflib.SequenceMatcher(None)
    out, second = [], None
    for x, y in zip(a, b, strict=True):
        if y != second:  # what is prepared for the second string serves all first ones
            one.set_seq2(y.lower())
            second = y
        one.set_seq1(x.lower())
        out.append(one.ratio())
    return pd.Series(out, dtype="float64")


def align(candidates: DataFrame, existing: DataFrame, least: float = 0.8) -> DataFrame:
    """(kind, name, existing, status, score) for candidates (kind, name) against declared names (kind, name) of their kind.

    Equal names whatever the case are matched; else the declared name with the best ratio of matching blocks is similar,
    if that is at least ``least`` (ties: the first by alphabet); else a candidate is new. Blocks are common subsequences, so
    pairs come from the similarity join, which loses none. Null and empty names are new.
    """
    told = candidates.select("kind", "name").distinct()
    exact = align_exact(told, existing)
    rest = exact.where("status = 'new'").select("kind", "name")
    pairs = similar_between(rest.select("name"), existing.select("name"), least)
    pairs = rest.join(pairs.select(F.col("a").alias("name"), F.col("b").alias("existing")), "name").join(existing.select("kind", F.col("name").alias("existing")).distinct(), ["kind", "existing"])
    scored = pairs.withColumn("score", matching_ratio("name", "existing")).where(F.col("score") >= least)
    best = scored.groupBy("kind", "name").agg(F.min(F.struct((-F.col("score")).alias("s"), "existing")).alias("b")).select("kind", "name", F.col("b.existing").alias("near"), (-F.col("b.s")).alias("score"))
    joined = exact.join(best, ["kind", "name"], "left")
    status = F.when(F.col("status") == "matched", "matched").when(F.col("near").isNotNull(), "similar").otherwise("new")
    return joined.select("kind", "name", F.coalesce("existing", "near").alias("existing"), status.alias("status"), F.round("score", 3).alias("score"))


def alignment_flags(aligned: DataFrame, existing: DataFrame) -> DataFrame:
    """One row: existing_empty, disjoint (something is declared, and no candidate matches or resembles it), has_mismatch."""
    some = existing.agg((F.count("*") == 0).alias("existing_empty"))
    c = aligned.agg(F.count("*").alias("n"), F.count_if(F.col("status") != "new").alias("known"), F.count_if(F.col("status") != "matched").alias("open"))
    both = some.join(F.broadcast(c))  # one row each
    disjoint = ~F.col("existing_empty") & (F.col("n") > 0) & (F.col("known") == 0)
    return both.select("existing_empty", disjoint.alias("disjoint"), ((F.col("open") > 0) | disjoint).alias("has_mismatch"))


def rename_map(aligned: DataFrame, decisions: DataFrame) -> DataFrame:
    """(kind, name, to): matched names take the declared form; decisions (kind, name, action, target) override: merge and map to the target, create keeps."""
    own = aligned.join(decisions.select("kind", "name", "action", "target"), ["kind", "name"], "left")
    to = F.when(F.col("action").isin("merge", "map") & F.col("target").isNotNull(), F.col("target")).when(F.col("action") == "create", F.lit(None).cast("string"))
    to = F.coalesce(to, F.when((F.col("status") == "matched") & ~F.col("action").eqNullSafe("create"), F.col("existing")))
    return own.select("kind", "name", to.alias("to")).where("to is not null and to <> name")


def schema_snapshot(triples: DataFrame) -> DataFrame:
    """(s, p, o) of declared classes and properties: types, labels, comments, domains, ranges, parents."""
    declared = triples.where("p = 'type'").where(F.col("o").isin("Class", "ObjectProperty", "DatatypeProperty")).select("s").distinct()
    return triples.where(F.col("p").isin(*STRUCTURAL)).join(declared, "s", "left_semi").distinct()


def instance_types(triples: DataFrame) -> DataFrame:
    """(s, type) rows whose type is a declared class."""
    classes = triples.where("p = 'type' and o = 'Class'").select(F.col("s").alias("type")).distinct()
    return triples.where("p = 'type'").select("s", F.col("o").alias("type")).join(classes, "type", "left_semi").distinct()


def promotion_report(steps: dict[str, DataFrame]) -> DataFrame:
    out = None
    for step, df in steps.items():
        one = df.agg(F.count("*").alias("value")).select(F.lit(step).alias("step"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def schema_view(tbox: DataFrame) -> DataFrame:
    """(source, target, label): parents, and domain to range of each property; ends must be classes, self links go.

    tbox: (s, p, o).
    """
    classes = tbox.where("p = 'type' and o = 'Class'").select(F.col("s").alias("c")).distinct()
    up = tbox.where("p = 'subClassOf'").select(F.col("s").alias("source"), F.col("o").alias("target"), F.lit("subClassOf").alias("label"))
    d, r = tbox.where("p = 'domain'").select("s", F.col("o").alias("source")), tbox.where("p = 'range'").select("s", F.col("o").alias("target"))
    links = up.unionByName(d.join(r, "s").select("source", "target", F.col("s").alias("label"))).where("source <> target")
    links = links.join(classes.select(F.col("c").alias("source")), "source", "left_semi")
    return links.join(classes.select(F.col("c").alias("target")), "target", "left_semi").select("source", "target", "label").distinct()


def schema_fallback(edges: DataFrame) -> DataFrame:
    """(label, target): predicates between entities, or to literals where any of their objects is one."""
    return edges.groupBy(F.col("predicate").alias("label")).agg(F.when(F.bool_or("is_literal"), "Literal").otherwise("Entity").alias("target"))


def apply_rename(triples: DataFrame, renames: DataFrame) -> DataFrame:
    """Predicates replaced by (name, to); ``to`` of null cancels a rename."""
    return triples.join(renames.select(F.col("name").alias("predicate"), F.col("to").alias("__to")), "predicate", "left").withColumn("predicate", F.coalesce("__to", "predicate")).drop("__to")


# Ranges of JSON Schema's simple types.
XSD = {"string": "string", "integer": "integer", "number": "decimal", "boolean": "boolean", "date-time": "dateTime"}


def json_schema_to_tbox(docs: DataFrame, body: str = "body") -> DataFrame:
    """(class, property, kind, range): properties of each definition; references are object properties."""
    shape = "struct<`$defs`:map<string,struct<properties:map<string,struct<type:string,format:string,`$ref`:string,items:struct<type:string,`$ref`:string>>>>>>"
    defs = docs.select(F.from_json(body, shape).alias("j")).select(F.explode(F.col("j.`$defs`")).alias("class", "d"))
    props = defs.select("class", F.explode("d.properties").alias("property", "v"))
    ref = F.coalesce(F.col("v.`$ref`"), F.col("v.items.`$ref`"))
    simple = F.coalesce(F.when(F.col("v.format") == "date-time", F.col("v.format")), F.col("v.items.type"), F.col("v.type"))
    ranges = F.create_map(*[F.lit(x) for pair in XSD.items() for x in pair])
    return props.select("class", "property", F.when(ref.isNotNull(), "object").otherwise("datatype").alias("kind"), F.coalesce(X.local_name(ref), F.try_element_at(ranges, simple), F.lit("string")).alias("range")).distinct()


def class_instances(types: DataFrame, labels: DataFrame, name: str, limit: int = 100) -> DataFrame:
    """(instance, label): the first instances of a class, with their first labels or local names; types: (s, type)."""
    own = types.where(F.col("type") == name).select(F.col("s").alias("uri")).distinct().orderBy("uri").limit(limit)
    return label_of(own, labels).withColumnRenamed("uri", "instance")
