"""What SQL cannot say: offsets, chains, similarity without loss, streams."""

import datetime
import difflib
import json
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvina.functions import similarity, vector, yaml_text
from corvina.functions import text as X
from corvina.operators import bm25, chunking, components, containment, graph, injected, jobs, maintenance, ontology, retrieval, search, similar, triples
from corvina.operators.components import connected_components
from corvina.plans import catalog
from corvina.sources import tables
from corvina.streaming import status

from .compare import rows_of, sql_rows

TEXT = "First sentence here. Second one! Third?\n\nNew paragraph with more words. " * 30


def test_chunk_offsets_give_the_content(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, ""), (3, None), (4, "x" * 2500)], "doc_id long, text string")
    texts = {1: TEXT, 4: "x" * 2500}
    for made, size in ((chunking.chunk_by_size(docs, 300, 50), 300), (chunking.chunk_sections(docs, 600, 100), 600), (chunking.pre_segment(docs, 500, 100), 500), (chunking.chunk_oe(docs, 400, 80), 400)):
        rows = made.collect()
        assert {r.doc_id for r in rows} == {1, 4}
        for r in rows:
            assert texts[r.doc_id][r.start_offset : r.end_offset] == r.content and len(r.content) <= size
    covered = set()
    for r in chunking.pre_segment(docs, 500, 100).where("doc_id = 1").collect():
        covered |= set(range(r.start_offset, r.end_offset))
    assert covered == set(range(len(TEXT)))


def test_parents_hold_their_children(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    parents, children = chunking.chunk_parent_child(docs, (500, 0), (120, 20))
    held = {r.parent_id: r.content for r in parents.collect()}
    assert all(r.content in held[r.parent_id] for r in children.collect())


def test_retrieval_chunks_are_numbered_through(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "Short text.")], "doc_id long, text string")
    rows = chunking.chunk_oe_rag(docs).where("doc_id = 1").collect()
    assert sorted(r.chunk_index for r in rows) == list(range(len(rows)))


def test_sections_follow_the_last_header(spark):
    lines = spark.createDataFrame([(1, 0, "a"), (1, 1, "# t"), (1, 2, "b"), (1, 3, "1.2 x"), (1, 4, "c"), (1, 5, "## u")], "doc_id int, n int, line string")
    got = {r.n: r.section_path for r in chunking.section_paths(lines).collect()}
    assert got == {0: None, 1: "s1", 2: "s1", 3: "1.2", 4: "1.2", 5: "s2"}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 12)] + [(50, i) for i in range(51, 60)] + [(70, 71), (71, 72), (72, 70), (80, 80)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 1 for i in range(1, 13)}, **{i: 50 for i in range(50, 60)}, 70: 70, 71: 70, 72: 70}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("one_task", [0, 150, 10**6])
def test_components_in_rounds_and_in_one_task(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rng = random.Random(one_task)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(170)] + [(f"c{i}", f"c{i + 1}") for i in range(100)] + [("h", f"h{i}") for i in range(90)]
    df = spark.createDataFrame([*edges, ("x", None), (None, None)], "a string, b string").repartition(5)
    got = {r.node: r.component for r in connected_components(df, "a", "b").collect()}
    assert got == {x: min(g) for g in forest_of(edges) if len(g) > 1 for x in g}


def plain_ratio(a, b):
    a, b = a.lower(), b.lower()
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


def odd_names(rng):
    base = ["".join(rng.choice("abcdE ") for _ in range(rng.randint(1, 24))) for _ in range(60)] + ["aaaa", "aaaaaa", "ab", "axb", "Ab", "a", "\u6210\u5947\u52cb", "\u6210\u5947", "x" * 70, "x" * 64, "xy" * 33]
    return sorted({*base, *("".join(c for c in b if rng.random() > 0.06) + rng.choice(["", "x"]) for b in base for _ in range(3))} - {""})


@pytest.mark.parametrize("least", [0.6, 0.8, 0.85, 0.95, 1.0])
def test_similar_strings_lose_no_pair(spark, least):
    names = odd_names(random.Random(2))
    df = spark.createDataFrame([(n, 1) for n in [*names, *names[:9], "", None]], "entity string, side int")
    got = {(r.a, r.b): r.ratio for r in similar.similar_strings(df, least).collect()}
    want = {(a, b): plain_ratio(a, b) for a in names for b in names if a < b and plain_ratio(a, b) >= least}
    assert got == want and want
    links = [(r.a, r.b) for r in similar.similar_links(df, least).collect()]
    assert forest_of(links) == forest_of(want)


def forest_of(pairs):
    root = {}
    for a, b in pairs:
        group = root.get(a, {a}) | root.get(b, {b})
        for x in group:
            root[x] = group
    return {frozenset(g) for g in root.values()}


def test_similar_strings_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 3)
    names = [f"Customer#{i:06d}" for i in range(0, 400, 7)] + [f"Order#{i}" for i in range(40)]
    df = spark.createDataFrame([(n,) for n in names], "entity string")
    got = [(r.a, r.b) for r in similar.similar_strings(df).collect()]
    assert sorted(got) == sorted((a, b) for a in names for b in names if a < b and plain_ratio(a, b) >= 0.85)
    assert similar.similar_strings(df.where("false")).count() == 0


def test_similar_pairs_count_in_one_cell_only():
    import pyarrow as pa

    def cell(key, earlier):
        x = ["customer#12", "customer#13"]
        cols = {"x": x, "l": x, "side": pa.array([3, 3], pa.int32()), "c": pa.nulls(2, pa.string()), "earlier": [earlier, ""], "offer": [True, False], "width": pa.array([2, 2], pa.int32()), "key": [key] * 2, "cell": [1, 1]}
        return pa.RecordBatch.from_pydict(cols)

    found = [r for b in similar._compare(0.85, True, False)(iter([cell("11:er", "r#"), cell("11:om", ""), cell("11:to", "12")])) for r in b.to_pylist()]
    assert [(r["a"], r["b"]) for r in found] == [("customer#12", "customer#13")] * 2  # "r#" is held, so the pair counts where "r#" is offered


def test_numbered_names_meet_in_blocks(spark, monkeypatch, least=0.8):
    """Names of crowded shapes, others near them, and long ones: no pair is lost or counted twice, and the groups are the same."""
    monkeypatch.setattr(similar, "CROWD", 6)
    monkeypatch.setattr(similar, "BLOCK", 7)
    monkeypatch.setattr(similar, "PAIRS", 90)
    rng = random.Random(4)
    numbered = [f"{w}#{rng.randrange(10**5):05}" for w in ("Customer", "customer", "costumer", "Maker") for _ in range(18)] + [f"{'long ' * 15}{k}" for k in range(40, 50)]
    names = sorted({*numbered, *(x.upper() for x in numbered[:9]), *odd_names(rng)[:60], "Customer#1234", "ustomer#x1234", "\u0130x#12345", "5", "7", "12"})
    df = spark.createDataFrame([(n,) for n in [*names, *names[:9], "", None]], "entity string")
    want = {(a, b): plain_ratio(a, b) for a in names for b in names if a < b and plain_ratio(a, b) >= least}
    blocks = []
    real = similar._in_blocks
    monkeypatch.setattr(similar, "_in_blocks", lambda *args: blocks.append(real(*args)) or blocks[-1])
    got = [((r.a, r.b), r.ratio) for r in similar.similar_strings(df, least).collect()]
    assert dict(got) == want and len(got) == len(want) > 0
    assert forest_of([(r.a, r.b) for r in similar.similar_links(df, least).collect()]) == forest_of(want)
    left, right = names[::2] + names[:5], names[1::2] + names[:10]
    found = similar.similar_between(spark.createDataFrame([(n,) for n in left], "name string"), spark.createDataFrame([(n,) for n in right], "name string"), least)
    assert sorted((r.a, r.b) for r in found.collect()) == sorted({(a, b) for a in left for b in right if plain_ratio(a, b) >= least})
    assert len(blocks) == 3


def test_rows_of_numbered_names_grow_with_blocks_only(spark):
    """Numbered names share most grams; dealt by grams, a name would come to dozens of cells for each block of two thousand."""
    names = spark.range(6_000).select(F.format_string("Customer#%09d", "id").alias("entity"))
    rows = spark.sparkContext.accumulator(0)

    def meet(*args):
        def run(batches):
            for b in batches:
                rows.add(b.num_rows)
            yield from ()

        return run

    was, similar._meet = similar._meet, meet
    try:
        similar.similar_strings(names).count()
    finally:
        similar._meet = was
    assert 6_000 <= rows.value <= 6_000 * 8


def test_groups_that_are_linked_are_not_compared_again(monkeypatch):
    low = [f"maker customer#{k:06}" for k in range(0, 3_000, 2)]
    groups = [f"g{k % 3}" for k in range(len(low) - 1)] + ["far"]
    low[-1] = "zzzzz customer#987654"
    done, real = [], similar.Columns.alike
    monkeypatch.setattr(similar.Columns, "alike", lambda self, lo, hi: done.append((hi - lo) * len(self.strings)) or real(self, lo, hi))
    every = np.arange(len(low))
    (links,) = similar._merged(low, groups, every, every, 0.85)
    assert forest_of([(r["a"], r["b"]) for r in links.to_pylist()]) == {frozenset(["g0", "g1", "g2"])}
    assert sum(done) < 0.02 * len(low) ** 2


def test_replies_of_a_small_file_are_parsed_by_many_tasks(spark, monkeypatch):
    class Parsed(Exception):
        pass

    def parse(replies):
        raise Parsed(replies.rdd.getNumPartitions())

    monkeypatch.setattr(triples, "parse_triples", parse)
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    replies = spark.range(50).coalesce(1).selectExpr("id as ord", "id as doc_id", "'a|b|c' as reply")
    known = spark.createDataFrame([("a", "b", "c", "d")], "subject string, predicate string, object string, doc_id string")
    with pytest.raises(Parsed) as told:
        jobs.ingest_text(docs, replies, known)
    assert told.value.args[0] >= 3


def test_triples_are_made_once_for_search_and_edges(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(30).selectExpr("id as ord", "concat('customer name ', id % 10) as subject", "'is' as predicate", "'thing' as object")
    told, suggestions = jobs.normalized(rows.mapInArrow(count, rows.schema))
    assert told.count() == 1 and suggestions.collect()[0].n_triples == 30 and seen.value == 30


def test_names_linked_beforehand_meet_in_no_cell(spark):
    rows = [("k", "g", "x1", True), ("k", "g", "x2", False), ("m", "g", "x1", True), ("m", "h", "y", False), ("m", "g", "x2", False)]
    got = similar._between_groups(spark.createDataFrame(rows, "key string, c string, x string, offer boolean")).select("key", "x").collect()
    assert {(r.key, r.x) for r in got if r.key.startswith("a")} == {("a:m", "x1"), ("a:m", "y")}
    names = [f"Customer#{k:05}" for k in range(60)]
    e = spark.createDataFrame([(n, n.lower(), len(n)) for n in [*names, "CUSTOMER#00000", "abc", "abd"]], "x string, l string, n int")
    parts = components.connected_components(similar._one_lost(e, 0.85), "a", "b").groupBy("component").count().collect()
    assert [r["count"] for r in parts] == [61]


def test_index_deals_texts_by_id_only(spark, monkeypatch):
    plans = []
    real = bm25.saved

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(bm25, "saved", kept)
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "  "), (4, "B c"), (4, "b c"), (None, "a")], "doc_id int, text string")
    index = bm25.build_inverted_index(docs)
    assert sum(p.count("hashpartitioning(id#") for p in plans) == 1 and not any("dl#" in x for p in plans for x in p.splitlines() if "hashpartitioning" in x)
    got = {(r.id, r.term): (r.tf, r.dl) for r in index.postings.collect()}
    assert got == {(1, "a"): (2, 3), (1, "b"): (1, 3), (4, "b"): (2, 2), (4, "c"): (2, 2), (None, "a"): (1, 1)}
    (s,) = index.stats.collect()
    lengths = docs.select(F.size(X.tokens(F.col("text"))).alias("n")).agg(F.avg("n")).first()[0]
    assert s.n == 6 and abs(s.avgdl - lengths) < 1e-12
    assert bm25.build_inverted_index(docs.where("false")).stats.collect()[0].n == 0


def test_injected_extractor_sees_each_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def extract(texts):
        seen.add(len(texts))
        return [[{"subject": t, "predicate": "is", "object": "x"}] for t in texts]

    found, failed = injected.extract_triples(spark.range(500).selectExpr("id as chunk_id", "concat('t', id) as content"), extract)
    assert found.count() == 500 and failed.count() == 0 and seen.value == 500


def test_similar_between_two_tables(spark):
    names = odd_names(random.Random(5))
    left, right = names[::2] + names[:5], names[1::2] + names[:10]
    found = similar.similar_between(spark.createDataFrame([(n,) for n in left], "name string"), spark.createDataFrame([(n,) for n in right], "name string"), 0.8)
    assert sorted((r.a, r.b) for r in found.collect()) == sorted({(a, b) for a in left for b in right if plain_ratio(a, b) >= 0.8})


def test_string_ratio_of_columns(spark):
    names = odd_names(random.Random(3))
    rows = [(a, b) for a in names[::5] for b in names[::7]] + [(None, "a"), ("", ""), ("x" * 200, "x" * 150 + "y"), (None, None)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", similarity.string_ratio("a", "b").alias("r")).collect()
    assert all(math.isclose(r.r, plain_ratio(r.a or "", r.b or "")) for r in got)


def test_particles_pronouns_and_noise(spark):
    rows = [("성기훈은", "성기훈"), ("오일남에게", "오일남"), ("나는", "나는"), ("  황  준호의 ", "황 준호")]
    df = spark.createDataFrame(rows, "x string, want string").withColumn("got", X.normalize_entity(F.col("x")))
    assert all(r.got == r.want for r in df.collect())
    t = spark.createDataFrame([(1, "성기훈", "관계", "b1", 1.0), (2, "그", "친구", "b1", 1.0), (3, "성기훈은", "친구", "오일남", 0.9), (4, "성기훈", "친구", "오일남", 0.8), (5, "성기훈", "스승", "오일남", 0.2)], "ord int, subject string, predicate string, object string, confidence double")
    assert [r.ord for r in triples.postprocess_triples(t).collect()] == [3]
    back = triples.add_inverse(t.where("ord = 5")).where("is_inverse").collect()
    assert [(r.subject, r.predicate, r.object) for r in back] == [("오일남", "제자", "성기훈")]


def test_status_stream_equals_batch(spark, tmp_path):
    rows = pd.DataFrame({"event_id": range(40), "doc_id": [i % 5 for i in range(40)], "ts": pd.to_datetime("2024-01-01") + pd.to_timedelta([(i * 37) % 101 for i in range(40)], unit="s"), "status": [f"s{i % 3}" for i in range(40)]})
    df = spark.createDataFrame(rows).select("event_id", "doc_id", F.col("ts").cast("timestamp").alias("ts"), "status")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = status.latest_status_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("latest").outputMode("update").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {tuple(r) for r in spark.table("latest").select("doc_id", "status", "ts").collect()} == {tuple(r) for r in status.latest_status(df).collect()}


def test_ingest_stream_equals_one_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Text {i}. " * (i * 9)) for i in range(30)] + [(2, "Text 2. " * 18), (99, None), (98, "")], "doc_id long, text string")
    for n, part in enumerate(docs.randomSplit([1.0] * 4, 5)):
        part.unionByName(docs.where("doc_id = 3")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        status.ingest_stream(source, str(tmp_path / "out"), str(tmp_path / "state"), size=100, overlap=20).awaitTermination()
    want = chunking.chunk_by_size(docs.dropDuplicates(["doc_id"]).select("doc_id", X.clean_text(F.col("text")).alias("text")), 100, 20)
    got = status.read_ingested(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, got.drop("chunk_id").collect())) == sorted(map(tuple, want.collect())) and got.count() > 30
    index = status.ingested_index(spark, str(tmp_path / "out"))
    direct = bm25.build_inverted_index(got, "chunk_id", "content")
    assert sorted(map(tuple, index.terms.collect())) == sorted(map(tuple, direct.terms.collect())) and index.stats.first() == direct.stats.first()
    # a batch that runs again from scratch writes the same folders
    before = got.count()
    status.ingest_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "other"), str(tmp_path / "s1"), size=100, overlap=20).awaitTermination()
    status.ingest_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "other"), str(tmp_path / "s2"), size=100, overlap=20).awaitTermination()
    assert status.read_ingested(spark, str(tmp_path / "other")).count() == before


@pytest.mark.parametrize("shuffled", [False, True])
def test_stale_stream_equals_batch_twin(spark, tmp_path, shuffled):
    rng = random.Random(4)
    rows = [(i, rng.randrange(12), datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i * 23 + rng.randrange(20)), rng.choice(["processing", "deleting", "completed", "pending"])) for i in range(900)]
    if shuffled:  # within what the watermark allows
        rows = [rows[k] for at in range(0, 900, 10) for k in rng.sample(range(at, at + 10), 10)]
    df = spark.createDataFrame(rows, "event_id long, doc_id long, ts timestamp, status string")
    for n in range(0, 900, 150):
        spark.createDataFrame(rows[n : n + 150], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime)
    assert len(files) == 6
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = status.stale_stream(source, "5 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    now = df.agg(F.max("ts") - F.expr("interval 5 minutes")).first()[0]
    want = sorted(map(tuple, status.stale_spells(df, now).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want and want
    assert left <= 12  # documents, not events


def test_alignment_equals_sequence_matcher(spark):
    rng = random.Random(8)
    known = [f"{rng.choice(['has', 'is', 'Part'])}{rng.choice('ABC')}{rng.choice(['name', 'Name', 'code', 'Kode'])}{rng.randrange(5)}" for _ in range(40)]
    asked = [k.upper() if rng.random() < 0.2 else k[: rng.randrange(3, len(k))] + rng.choice(["", "x", "Of"]) for k in known] + ["", "zzz", "e"]
    c = spark.createDataFrame([(k, n) for k in ("class", "property") for n in asked], "kind string, name string")
    e = spark.createDataFrame([("class", n) for n in known[:25]] + [("property", n) for n in known[15:]], "kind string, name string")
    got = {(r.kind, r.name): (r.status, r.existing, r.score) for r in ontology.align(c, e).collect()}

    def plain(kind, name):
        mine = sorted(set(known[:25] if kind == "class" else known[15:]))
        equal = [n for n in mine if n.lower() == name.lower()]
        if equal:
            return ("matched", equal[0], None)
        scored = [(-difflib.SequenceMatcher(None, name.lower(), n.lower()).ratio(), n) for n in mine]
        best = min(scored)
        return ("similar", best[1], round(-best[0], 3)) if -best[0] >= 0.8 else ("new", None, None)

    assert got == {(k, n): plain(k, n) for k in ("class", "property") for n in asked}
    flags = ontology.alignment_flags(ontology.align(c.where("name = 'zzz'"), e), e).first()
    assert (flags.existing_empty, flags.disjoint, flags.has_mismatch) == (False, True, True)
    none = ontology.align(c, e.where("false"))
    assert {r.status for r in none.collect()} == {"new"} and ontology.alignment_flags(none, e.where("false")).first().existing_empty
    decisions = spark.createDataFrame([("class", asked[0], "map", "Other"), ("class", asked[1], "create", None)], "kind string, name string, action string, target string")
    renames = {(r.kind, r.name): r.to for r in ontology.rename_map(ontology.align(c, e), decisions).collect()}
    assert renames[("class", asked[0])] == "Other" and ("class", asked[1]) not in renames


def test_yaml_and_json_records_are_equal(spark, tmp_path):
    record = {"id": "c1", "name": "Kim: #1", "n": 3, "x": -1.5, "none": None, "yes": True, "tags": ["a b", "it's", 'q"q'], "at": {"city": "Ulm", "lines": [{"k": 1}, {"k": 2, "deep": ["x"]}]}, "note": "one\ntwo\n"}
    text = """# a record
---
id: c1
name: "Kim: #1"   # comment
n: 3
x: -1.5
none: ~
yes: true
tags:
- a b
- 'it''s'
- "q\\"q"
at:
  city: Ulm
  lines:
    - k: 1
    - k: 2
      deep: [x]
note: |
  one
  two
"""
    for name, body in (("a.yaml", text), ("b.yml", text), ("c.json", json.dumps(record)), ("bad.yaml", "a: [1"), ("bad.json", "{"), ("skip.txt", "a: 1")):
        (tmp_path / name).write_text(body)
    got = {r.doc_id: r.b for r in tables.read_structured(spark, str(tmp_path)).select("doc_id", F.to_json("body").alias("b")).collect()}
    assert got.pop("bad") is None and set(got) == {"a", "b", "c"}
    assert all(json.loads(b) == record for b in got.values())


@pytest.mark.parametrize("text", ["a: [1, 2", "&x y", "- a\nb: 1", '"x', "a: 1\n---\nb: 2", "a: b: c", "a:\n\t- 1"])
def test_unreadable_yaml_is_null(text):
    assert yaml_text.yaml_to_json(text) is None


def test_yaml_scalars_and_blocks():
    parsed = yaml_text.parse_yaml("a: >-\n  x\n  y\n\n  z\nb: plain\n  goes on\nc: {k: [1, 'x, y'], m}\nd: 12:30\ne: http://a/b#c\nf:\n- - 1\n  - 2\n- p: q\n  r:\n  - s\n")
    assert parsed == {"a": "x y\nz", "b": "plain goes on", "c": {"k": [1, "x, y"], "m": None}, "d": "12:30", "e": "http://a/b#c", "f": [[1, 2], {"p": "q", "r": ["s"]}]}


def test_resumed_stages_work_on_what_is_open(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "doc_id long, text string")
    stages = [("a", lambda df: df.withColumn("text", F.concat("text", F.lit("a")))), ("b", lambda df: df.withColumn("text", F.explode(F.array("text", F.concat("text", F.lit("b"))))))]
    root = str(tmp_path / "kb")
    _, worked = tables.resume_stages(docs.where("doc_id < 7"), root, "k", stages[:1], "one")
    assert worked == {"a": 7}
    # a run that broke off after writing its rows, before marking them, is repeated and counts once
    stages[0][1](docs.where("doc_id >= 7")).withColumns({"part": F.pmod(F.xxhash64("doc_id"), F.lit(tables.STAGE_PARTS)).cast("int"), "run": F.lit("two")}).write.mode("append").partitionBy("run", "part").parquet(f"{root}/rows/stage=a/kb=k")
    told, worked = tables.resume_stages(docs, root, "k", stages, "two")
    assert worked == {"a": 13, "b": 20}
    want = sorted((i, t) for i in range(20) for t in (f"t{i}a", f"t{i}ab"))
    assert sorted(map(tuple, told.select("doc_id", "text").collect())) == want
    told, worked = tables.resume_stages(docs, root, "k", stages, "three")
    assert worked == {"a": 0, "b": 0} and sorted(map(tuple, told.select("doc_id", "text").collect())) == want


def test_injected_functions_keep_failing_rows(spark):
    rows = spark.createDataFrame([(i, str(i)) for i in range(40)] + [(99, None)], "id long, text string").repartition(2)

    def work(b):
        return [int(t) * 2 if t != "7" else [] for t in b["text"]]  # null fails, 7 gives another type

    got = {r.id: (r.value, r.error) for r in injected.apply_injected(rows, work, ["text"], "value long", 8).collect()}
    assert {k: v[0] for k, v in got.items()} == {**{i: i * 2 for i in range(40)}, 7: None, 99: None}
    assert got[7][1] and got[99][1].startswith("TypeError") and sum(v[1] is not None for v in got.values()) == 2
    assert injected.apply_injected(rows.where("false"), work, ["text"], "value long").count() == 0


def test_lsh_pairs_stay_in_their_cells(spark, monkeypatch):
    """The best k of each cell are all that leaves it; they are those of all pairs in a bucket below the distance, whatever the lengths of vectors."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.linalg import Vectors

    r = np.random.default_rng(5)
    made = r.normal(size=(400, 6)) * r.choice([0.3, 0.8, 1.5], size=(400, 1))
    made[7], made[11] = 0.0, made[10]
    rows = [(i, v.tolist()) for i, v in enumerate(made)]
    odd = [(900, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (901, None), (902, [float("nan")] * 6), (903, [float("inf")] * 6)]
    df = spark.createDataFrame(rows + odd + rows[:20], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame(rows[:40] + odd, "query_id long, query_vec array<double>")
    model = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=0.5, numHashTables=3, seed=1).fit(spark.createDataFrame([(Vectors.dense(v),) for _, v in rows], ["f"]))
    hashes = model.transform(spark.createDataFrame([(i, Vectors.dense(v)) for i, v in rows], ["id", "f"])).select("id", "h").collect()
    h = {x.id: [y[0] for y in x.h] for x in hashes}
    want = set()
    for q in range(40):
        near = [i for i in range(400) if any(a == b for a, b in zip(h[q], h[i], strict=True)) and math.sqrt(sum((a - b) ** 2 for a, b in zip(rows[q][1], rows[i][1], strict=True))) < 1.6]
        norms = np.linalg.norm(made[near], axis=1) * np.linalg.norm(made[q])
        score = dict(zip(near, np.where(norms == 0, 0.0, made[near] @ made[q] / np.where(norms == 0, 1, norms)), strict=True))
        want |= {(q, i, n) for n, i in enumerate(sorted(near, key=lambda i: (-round(score[i], 9), i))[:10], 1)}
    counts, whole = [], search.nearest_in_cells

    def counted(*args):
        out = whole(*args)
        counts.append(out.count())
        return out

    monkeypatch.setattr(search, "nearest_in_cells", counted)
    for block, queries in ((50_000, 10_000), (60, 15)):
        monkeypatch.setattr(search, "KNN_BLOCK", block)
        monkeypatch.setattr(search, "KNN_QUERIES", queries)
        assert {(x.query_id, x.id, x["rank"]) for x in search.knn_lsh(df, asked, 10, 0.5, 3).collect()} == want
    assert len(counts) == 2 and counts[0] <= 40 * 3 * 10
    assert search.knn_lsh(df.where("false"), asked, 10).count() == 0


def test_ivf_reaches_its_recall(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = vectors.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    exact = {(r.query_id, r.id) for r in search.knn_exact(vectors, asked, 10).collect()}
    found = {(r.query_id, r.id) for r in search.knn_ivf(vectors, asked, 10, 32).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    # clustered vectors: few cells suffice
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(20, 16))
    rows = [(i, (centre[i % 20] + 0.1 * rng.normal(size=16)).tolist()) for i in range(1_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    centres, held = search.ivf_cells(df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 20, 1)
    assert search.fitted_probes(held, centres, 10, 0.95, 1) <= 5
    asked = df.where("vec_id < 50").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    exact = {(r.query_id, r.id) for r in search.knn_exact(df, asked, 10).collect()}
    assert len(exact & {(r.query_id, r.id) for r in search.knn_ivf(df, asked, 10, 20).collect()}) >= 0.9 * len(exact)
    assert search.knn_ivf(df.where("false"), asked, 10, 20).count() == 0


def test_listing_pages_go_on_where_others_end(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("abc"), rng.choice(["p", None, "q"]), f"o{rng.randrange(9)}", rng.random()) for i in range(300)]
    e = spark.createDataFrame(rows, "ord long, subject string, predicate string, object string, confidence double").repartition(7)
    want = sorted(rows, key=lambda r: (r[2] is None, [-ord(c) for c in r[2] or ""], r[3], r[1], r[0]))
    got = []
    for at in range(0, 310, 70):
        page, total = graph.list_triples(e, skip=at, limit=70, sort=[("predicate", "desc"), ("object", "asc")])
        got += [(r.place, r.ord) for r in page.orderBy("place").collect()]
        assert total.first().total == 300
    assert got == [(n, r[0]) for n, r in enumerate(want)]


def test_stored_ingestion_and_revert(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Some text. " * 200)], "doc_id long, text string")
    reply = '{"triples": [{"subject": "Anna Maria", "predicate": "knows", "object": "Bernd"}, {"subject": "Anna Marie", "predicate": "knows", "object": "Bernd"}]}'
    replies = spark.createDataFrame([(1, 1, reply)], "ord long, doc_id long, reply string")
    known = spark.createDataFrame([("x", "y", "z", 5)], "subject string, predicate string, object string, doc_id long")
    done = jobs.ingest_text(docs, replies, known)
    assert {(r.subject, r.predicate, r.object) for r in done.edges.collect()} == {("x", "y", "z"), ("Anna Maria", "knows", "Bernd")}
    assert [(r.canonical, r.variants, r.n_triples) for r in done.suggestions.collect()] == [("Anna Maria", ["Anna Marie"], 1)] or done.suggestions.count() == 1
    jobs.store(done, str(tmp_path / "kb"), "k1")
    stored = spark.read.parquet(str(tmp_path / "kb" / "chunks"))
    assert stored.count() == done.chunks.count() and stored.select("chunk_id").distinct().count() == stored.count()
    rows = [("C", "type", "Class"), ("C", "label", "c"), ("x", "type", "C"), ("x", "y", "z")]
    t = spark.createDataFrame(rows, "s string, p string, o string")
    assert sorted(map(tuple, jobs.revert(t).collect())) == [("x", "type", "C"), ("x", "y", "z")]


def test_strategies_are_their_compositions(spark):
    rng = np.random.default_rng(2)
    words = ["성기훈 씨가", "red", "blue", "오일남", "green", "game", "score"]
    rows = [(i, " ".join(words[int(k)] for k in rng.integers(0, 7, 12)), rng.normal(size=6).tolist()) for i in range(60)]
    chunks = spark.createDataFrame(rows, "id long, content string, vector array<double>")
    asked = spark.createDataFrame([(q, f"{words[q]} game", rng.normal(size=6).tolist()) for q in range(4)], "query_id long, query_text string, query_vec array<double>")
    t = retrieval.Tables(chunks, bm25.build_inverted_index(chunks, "id", "content"))
    near = lambda k: search.knn_exact(chunks, asked, k, id_col="id", vector_col="vector")

    def rows_of(df):
        return sorted((r.query_id, r.id, round(r.score, 9), r["rank"]) for r in df.collect())

    assert rows_of(retrieval.retrieve("keyword", t, asked)) == rows_of(bm25.bm25_search(t.index, asked, 10))
    assert rows_of(retrieval.retrieve("no such", t, asked)) == rows_of(near(10)) == rows_of(retrieval.retrieve("vector", t, asked))
    assert rows_of(retrieval.retrieve("hybrid", t, asked)) == rows_of(search.rrf_fuse([bm25.bm25_search(t.index, asked, 30), near(30)], top=10))
    two = retrieval.retrieve("2-stage", t, asked, retrieval.Options(k=3))
    assert {r["rank"] for r in two.collect()} == {1, 2, 3} and {(r.query_id, r.id) for r in two.collect()} <= {(r.query_id, r.id) for r in near(15).collect()}
    plain = {(r.query_id, r.id): r.score for r in retrieval.retrieve("vector", t, asked).collect()}
    for r in retrieval.retrieve("vector", t, asked, retrieval.Options(entity_penalty=0.3)).collect():
        text, query = rows[r.id][1], words[r.query_id]
        miss = (r.query_id == 0 and "성기훈" not in text) or (r.query_id == 3 and "오일남" not in text)
        assert math.isclose(r.score, plain[(r.query_id, r.id)] * (0.3 if miss and query else 1.0), rel_tol=1e-9, abs_tol=1e-12)
    best = retrieval.retrieve("vector", t, asked, retrieval.Options(rerank=True, l2_distance=2.5)).collect()
    assert all(1 / 3.5 <= r.score <= 1 for r in best)
    assert retrieval.retrieve("mine", t, asked, strategies={"vector": retrieval.STRATEGIES["vector"], "mine": lambda t, q, o: near(1)}).count() == 4


def _odd_vectors():
    rng = random.Random(3)
    rows = []
    for i in range(240):
        v = [rng.choice([-1.0, 0.0, 0.5, 1.0, 2.0]) for _ in range(6)]
        odd = {17: None, 19: [1.0, None, 2.0, 0.0, 0.0, 1.0], 23: v[:4], 29: [0.0] * 6, 31: [math.nan, *v[1:]], 37: [math.inf, *v[1:]], 41: [], 5: [1.0, 0.5, 0.0, -1.0, 2.0, 1.0]}
        rows.append((i, next((x for n, x in odd.items() if i % n == 0), v)))
    return rows


@pytest.mark.parametrize("metric", ["COSINE", "IP", "L2"])
@pytest.mark.parametrize("threshold", [None, 0.2])
def test_exact_search_in_many_cells(spark, monkeypatch, metric, threshold):
    """Cells give what a join of all pairs gives, with copies, nulls, zeros, odd lengths and numbers that aren't finite."""
    monkeypatch.setattr(search, "KNN_BLOCK", 50)
    monkeypatch.setattr(search, "KNN_QUERIES", 20)
    df = spark.createDataFrame(_odd_vectors(), "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 3 = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    value = {"COSINE": vector.cosine, "IP": vector.inner, "L2": vector.l2}[metric](F.col("embedding"), F.col("query_vec"))
    pairs = asked.crossJoin(df).select("query_id", F.col("vec_id").alias("id"), vector.score_from_metric(value, metric).alias("score"))
    pairs = search.ranked(pairs.where(F.col("score") >= threshold) if threshold else pairs).where("rank <= 7").select("query_id", "id", "score", "rank")
    got = search.knn_exact(df, asked, 7, metric, threshold).select("query_id", "id", "score", "rank")
    assert "Join" not in got._jdf.queryExecution().toString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, pairs.collect()))


def test_example_search_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(maintenance, "EXAMPLE_BLOCK", 20)
    monkeypatch.setattr(maintenance, "QUERY_BLOCK", 15)
    df = spark.createDataFrame([(i, i % 7 % 3 or None, v) for i, v in _odd_vectors()], "id long, kb long, v array<double>").withColumn("backend", F.lit("x"))
    held, asked = df.withColumnRenamed("v", "question_vector"), df.where("id % 2 = 1").withColumnsRenamed({"id": "query_id", "v": "query_vec"})
    pairs = asked.join(held, ["kb", "backend"]).select("query_id", "id", vector.cosine(F.col("question_vector"), F.col("query_vec")).alias("score")).where("score >= 0.3")
    want = search.ranked(pairs).where("rank <= 3").select("query_id", "id", "score", "rank")
    got = maintenance.example_search(held, asked, 3, 0.3).select("query_id", "id", "score", "rank")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert maintenance.example_search(held.where("false"), asked, 3, 0.3).count() == 0


def test_shares_are_rounded_as_in_sql(spark, tmp_path):
    """85.5 / 300 is a little less than 0.285; the events of the test tables hold few such values."""
    values = [85.5, 1.5, 4.5, 172.5, 0.0, 0.3, 299.0, 560.21, 43.5] + [n * 1.5 for n in range(400)]
    spark.createDataFrame([(3 * i, v) for i, v in enumerate(values)], "event_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert rows_of(catalog.QUERIES["f07_parse_scores"](spark, str(tmp_path))) == sql_rows(con, catalog.ORACLES["f07_parse_scores"])


def test_probed_cells_are_searched_in_blocks(spark):
    """What IVF visits is compared by whole cells: no join of rows with queries is left."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(600)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    got = search.knn_ivf(df, asked, 10, 4, 4)
    assert got._jdf.queryExecution().toString().count("MapInArrow run(cell") > 0
    want = search.knn_exact(df, asked, 10)
    assert [(r.query_id, r.id) for r in got.orderBy("query_id", "rank").collect()] == [(r.query_id, r.id) for r in want.orderBy("query_id", "rank").collect()]


def test_evidence_is_found_in_cells(spark, monkeypatch):
    """Triples meet the texts of their documents by automata in bounded cells, not pair by pair; nulls and empty names as in SQL."""
    monkeypatch.setattr(containment, "BLOCK", 40)
    monkeypatch.setattr(containment, "PART", 60)
    rng = random.Random(3)
    names = [None, "", "Ab", "abc", "B c", "ca", "Ü", *("".join(rng.choices("abC ", k=rng.randint(1, 4))) for _ in range(20))]
    rows = [(n, f"d{n % 3}", rng.choice(names), rng.choice(names)) for n in range(150)]
    texts = [(f"d{n % 4}", f"d{n % 4}_{n}", rng.choice([None, "", *("".join(rng.choices("ABc ü", k=rng.randint(1, 12))) for _ in range(6))])) for n in range(40)]
    t = spark.createDataFrame(rows, "ord long, doc_id string, subject string, object string")
    c = spark.createDataFrame(texts, "doc_id string, chunk_id string, content string")
    made = triples.evidence_match(t, c)
    assert "contains(" not in made._jdf.queryExecution().optimizedPlan().toString().lower()
    con = duckdb.connect()
    con.register("t", pd.DataFrame(rows, columns=["ord", "doc_id", "subject", "object"]))
    con.register("c", pd.DataFrame(texts, columns=["doc_id", "chunk_id", "content"]))
    want = con.execute(
        "with p as (select ord, chunk_id, contains(lower(content), lower(subject)) or contains(lower(content), lower(object)) as named from t join c using (doc_id)), "
        "q as (select *, max(named) over (partition by ord) as some_named from p) "
        "select ord, chunk_id from (select *, row_number() over (partition by ord order by chunk_id) as n from q where named or not some_named) where n <= 3"
    ).fetchall()
    assert sorted((r.ord, r.chunk_id) for r in made.collect()) == sorted(want) and len(want) > 200


def test_labels_meet_mentions_in_cells(spark, monkeypatch):
    """Many mentions that begin alike are not joined with every label that holds their first characters."""
    monkeypatch.setattr(containment, "BLOCK", 200)
    monkeypatch.setattr(containment, "PART", 300)
    labels = [(f"http://kg/{'inst' if i % 3 else 'class'}/urn{i % 40}", f"{'URN' if i % 2 else 'urn'}{i}") for i in range(120)] + [("http://kg/inst/x", None), ("http://kg/inst/y", "")]
    tokens = ["", "urn", "Urn1", "urn7", "9", "inst", "zz", *(f"urn{i}" for i in range(60))]
    m = spark.createDataFrame([(n, n, t) for n, t in enumerate(tokens)], "query_id long, pos long, token string")
    named = spark.createDataFrame(labels, "uri string, label string")
    made = retrieval._best_candidates(m.select("token").where("token <> ''"), named.select("uri", F.col("label").alias("name")))
    assert "contains(" not in made._jdf.queryExecution().optimizedPlan().toString().lower()

    def key(t, name, uri):
        t, c = t.lower(), name.lower()
        return -((100 if t == c else 60 if c.startswith(t) else 30) + max(0, 20 - len(c) + len(t))), name, uri

    want = {t: min(key(t, n, u) for u, n in labels if n and t.lower() in n.lower())[2] for t in tokens if t and any(n and t.lower() in n.lower() for _, n in labels)}
    assert {r.token: r.uri for r in made.collect()} == want and len(want) > 50


def test_numbered_names_are_found_by_their_shapes(spark, monkeypatch):
    """Texts and patterns of few shapes aren't dealt to cells block by block; pieces at several places, overlaps and repeats count as in SQL."""
    rng = random.Random(6)
    patterns = [(n % 2, x) for n in range(2) for x in (None, "", "a", "b-", "Ü7", *(f"a{k}" for k in range(40)), *(str(k) for k in range(60)), *(f"{k:03}-b" for k in range(0, 999, 7)))] + [(None, "a1"), (2, "a1")]
    texts = [(n % 3 if n % 17 else None, n // 2, rng.choice([None, "", "no", "Ü7a", *(f"a{rng.randrange(10**6):06}-b" for _ in range(9)), f"{rng.randrange(999):03}-b{rng.randrange(99):02}a9"])) for n in range(900)]
    p, t = spark.createDataFrame(patterns, "scope int, pattern string"), spark.createDataFrame(texts, "scope int, id long, text string")
    want = sorted((s, x, i) for s, i, text in texts if s is not None and text for x in {x for z, x in patterns if z == s and x and x in text})
    rows = []
    real = containment._in_cells
    monkeypatch.setattr(containment, "_in_cells", lambda a, b, sizes: rows.append(a.count() + b.count()) or real(a, b, sizes))
    assert sorted(map(tuple, containment.containing(p, t).collect())) == want and len(want) > 1_000
    monkeypatch.setattr(containment, "MANY", 0)
    monkeypatch.setattr(containment, "BLOCK", 60)
    monkeypatch.setattr(containment, "PART", 600)
    assert sorted(map(tuple, containment.containing(p, t).collect())) == want
    assert rows[1] < rows[0] / 10


def test_clickable_names_meet_nodes_in_cells(spark, monkeypatch):
    monkeypatch.setattr(containment, "BLOCK", 60)
    monkeypatch.setattr(containment, "PART", 60)
    rng = random.Random(5)
    nodes = [None, "", "a", "A_b", *("".join(rng.choices("abC_ ", k=rng.randint(1, 5))) for _ in range(40))]
    names = ["", "B", "zz", *("".join(rng.choices("aBc_ d", k=rng.randint(1, 6))) for _ in range(60))]
    pairs = graph._contains_pairs(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(n,) for n in nodes], "node string"))
    assert "contains(" not in pairs._jdf.queryExecution().optimizedPlan().toString().lower()
    want = {(a, b) for a in names for b in nodes if a and b and len(b) > 1 and (a.lower() in b.lower() or b.lower() in a.lower())}
    got = [(r.name, r.node) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want) > 100


def test_chunks_leave_in_bounded_batches(spark, monkeypatch):
    """A batch of many long texts isn't held as one table of all its chunks."""
    caught, own = [], type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, f, kind: caught.append(f) or own(df, f, kind))
    monkeypatch.setattr(chunking, "HELD", 5_000)
    docs = spark.createDataFrame([(n, TEXT if n % 5 else None) for n in range(20)], "doc_id long, text string")
    want = [(n, TEXT[lo:hi]) for n in range(20) if n % 5 for lo, hi in chunking.split_recursively(TEXT, 300, 50)]
    chunking.chunk_by_size(docs, 300, 50)
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array([TEXT if n % 5 else None for n in range(20)])], names=["id", "text"])
    made = list(caught[0](iter([batch])))
    assert len(made) > 5 and all(sum(map(len, b.column("content").to_pylist())) <= 5_300 for b in made)
    assert [(i, c) for b in made for i, c in zip(b.column("id").to_pylist(), b.column("content").to_pylist(), strict=True)] == want


def test_relations_with_most_triples_are_not_gathered(spark, sf_dir):
    """Triples stay where they are when they meet a schema's properties or rules."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        t = spark.createDataFrame([("a", "p", "b")], "s string, p string, o string")
        props = spark.createDataFrame([("p", [], "D", "R")], "name string, source_relations array<string>, domain string, range string")
        made = ontology.type_instances(t, props)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(map(tuple, made.collect())) == [("a", "D"), ("b", "R")]
        e = spark.createDataFrame([("a", "p", "b", 1), ("b", "q", "c", 1), ("b", "q", "d", 2)], "subject string, predicate string, object string, doc_id int")
        found = graph.infer_two_hop(e, spark.createDataFrame([("r", "p", "q", "i")], "rule string, p1 string, p2 string, inferred string"), "doc_id")
        assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in found.collect()] == [("a", "i", "c", "r")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_postings_of_a_batch_are_counted_where_chunks_lie(spark, tmp_path, monkeypatch):
    """Chunks are dealt by their ids in parts of bounded size before they fall into tokens; tokens are not shuffled."""
    monkeypatch.setattr(status, "CHUNKS_AT_ONCE", 5, raising=False)
    texts = [(i, " ".join(f"w{(i * k) % 13}" for k in range(40 + i))) for i in range(60)]
    spark.createDataFrame([*texts, texts[3]], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    status.ingest_stream(source, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    files = list((tmp_path / "out" / "postings" / "batch=0").glob("*.parquet"))
    lots = [{r.id for r in spark.read.parquet(str(f)).collect()} for f in files]
    assert len(lots) > 8 and sum(map(len, lots)) == len(set().union(*lots)) == 60 and max(map(len, lots)) < 30
    got = {(r.id, r.term): (r.tf, r.dl) for r in status.ingested_index(spark, f"{tmp_path}/out").postings.collect()}
    want = {(f"{i}_0", w): (t.split().count(w), len(t.split())) for i, t in texts for w in set(t.split())}
    assert got == want


def test_components_without_their_leaves(spark, monkeypatch):
    """Ends with a single edge take no part in the rounds; trees, stars, pairs and rings come out as one task makes them."""
    rng = random.Random(6)
    pairs = [(f"o{i}", f"c{rng.randrange(40)}") for i in range(400)] + [(f"c{i}", f"n{i % 4}") for i in range(30)]
    pairs += [("x1", "x2"), ("z", "a"), ("self", "self"), *[(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)], *[(f"p{i:02}", f"p{i + 1:02}") for i in range(20)]]
    df = spark.createDataFrame([*pairs, (None, "q")], "a string, b string")
    want = {(r.node, r.component) for r in connected_components(df, "a", "b").collect()}
    rounds, whole = [], components._large_star

    def counted(edges, limit):
        rounds.append(edges.count())
        return whole(edges, limit)

    monkeypatch.setattr(components, "ONE_TASK", 3)
    monkeypatch.setattr(components, "_large_star", counted)
    got = connected_components(df, "a", "b").collect()
    assert len(got) == len(want) and {(r.node, r.component) for r in got} == want
    assert max(rounds, default=0) < 100
