"""The training-data operators against brute force, on small tables with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from corvina.llm import curve_search, gru, lm_score, packing, pivot_dedup, prefix_bpe, quality, queries, simhash_dedup, suffix_dedup, suffix_sort, token_files, url_rules  # noqa: E402
from corvina.llm.encoding import Encoder  # noqa: E402

from ..compare import connect, rows_of, sql_rows  # noqa: E402

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
rng = random.Random(7)
WORDS = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 9))) for _ in range(300)]
PASSAGE = " ".join(rng.choice(WORDS) for _ in range(70))


def prose(n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


LONG = prose(6_000)
TEXTS = [
    None, "", "   \n", "one", "one two", "One TWO three.", PASSAGE, "x " + PASSAGE, "intro words " + PASSAGE + " and " + prose(40), prose(200), prose(200), LONG, LONG, LONG + " tail",
    "é́ñ ΟΔΟΣ 日本 🎉 İ  double  blanks\ttab\r\n", "<|endoftext|> and <|startoftext|>", "a\x1cb \x0b c\x85d\u00a0e", "aaaa" * 60, "aaaa" * 60 + "b", prose(30), prose(30),
    "x <|ENDOFTEXT|> y", "a<|startOFtext|>", "Don't \u2018quote\u2019 \u2014 Stra\u00dfe's na\u00efve, (caf\u00e9) 12,345.67 x\u00b2 \u00bd @home #1!",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, repeats, ties, a very long text, and columns whose names operators use themselves."""
    rows = [(i, t, "en" if i % 2 else None, "s", i * 10, float(i), i, "z") for i, t in enumerate(TEXTS)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, id string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


def test_url_rules(spark, sf_dir):
    name = "op6_url_rules"
    assert rows_of(queries.QUERIES[name](spark, sf_dir)) == sql_rows(connect(sf_dir), queries.ORACLES[name])
    urls = [None, "", "x", "http://", "HTTP://A.Example.COM/en/7?x#y", "http://example.com/en/70", "http://notexample.com/en/", "http://com/en/a", "http://.net/de/", "ftp://example.net#/de/8", "http://a.example.net/de/8/",
            "http://a.com/en/\U0010ffffx", "http://a.com/en/\U0010ffff", "http://b.org/es/\U0010ffff\U0010ffff", "http://a.com/en\U0010ffff/", "http://x.net/de/" + "p" * 200_000] * 2
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id int, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, url_rules.parse_rules(spark, queries.URL_RULES)).collect()}
    want = [("", "", None, "allow")] * 4 + [("a.example.com", "/en/7", "example.com/en/7", "allow"), ("example.com", "/en/70", "example.com/en/7", "allow"), ("notexample.com", "/en/", "com/en/", "block"), ("com", "/en/a", "com/en/", "block"),
            (".net", "/de/", "net/de/", "block"), ("example.net", "", None, "allow"), ("a.example.net", "/de/8/", "example.net/de/8", "block"), ("a.com", "/en/\U0010ffffx", "com/en/", "block"), ("a.com", "/en/\U0010ffff", "com/en/", "block"),
            ("b.org", "/es/\U0010ffff\U0010ffff", "org/es/", "block"), ("a.com", "/en\U0010ffff/", None, "allow"), ("x.net", "/de/" + "p" * 200_000, "net/de/", "block")]
    assert [got[i] for i in range(len(urls))] == want * 2
    assert url_rules.judge_urls(pages.limit(0), url_rules.parse_rules(spark, queries.URL_RULES)).count() == 0
    assert {r.verdict for r in url_rules.judge_urls(pages, url_rules.parse_rules(spark, [])).collect()} == {"allow"}


def test_url_rules_are_those_of_the_contract(spark):
    listed = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert queries.URL_RULES == tuple(tuple(rule.split(" ")) for rule in listed.split(", "))
    pages = spark.createDataFrame([("http://x.net/de/1",), ("http://example.net/de/7",), ("http://a.example.net/de/81",)], "url string")
    got = {r.url: (r.rule, r.verdict) for r in url_rules.judge_urls(pages, url_rules.parse_rules(spark, queries.URL_RULES)).collect()}
    assert got == {"http://x.net/de/1": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"), "http://a.example.net/de/81": ("example.net/de/8", "block")}


def test_nested_rules_take_the_longest(spark):
    rules = [("block", "a.b"), ("allow", "a.b/x"), ("block", "a.b/x/y"), ("block", "b/x/"), ("allow", "c.a.b/")]
    urls = ["u://a.b", "u://a.b/x", "u://a.b/xz", "u://a.b/x/y/z", "u://q.b/x/1", "u://c.a.b/x/y", "u://c.a.b", "u://d.c.a.b/", "u://b"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")

    def judge(u):
        host, path = re.match(r"u://([^/]*)(.*)", u).groups()
        best = None
        for action, rule in rules:
            h, p = (rule + "/").split("/", 1)[0], rule[len((rule + "/").split("/", 1)[0]) :]
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or (len(rule), len(h)) > (len(best[1]), len((best[1] + "/").split("/")[0]))):
                best = action, rule
        return best[0] if best else "allow"

    assert {r.url: r.verdict for r in url_rules.judge_urls(pages, url_rules.parse_rules(spark, rules)).collect()} == {u: judge(u) for u in urls}


def _words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]


def _fingerprint(t, k=4):
    w = _words(t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]), seed=42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(spark, docs, none):
    got = {r.id: (r.fp & (2**64 - 1), r.component_id) for r in simhash_dedup.near_duplicates(docs).collect()}
    fps = [_fingerprint(t) for t in TEXTS]
    assert got == dict(enumerate(zip(fps, _components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4), strict=True)))
    assert simhash_dedup.near_duplicates(none).count() == 0
    kept = simhash_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and {11, 13} & {r.doc_id for r in kept.collect()} == {11}


@pytest.mark.parametrize("distance", [3, 4, 7, 12])
def test_pigeonhole_finds_every_link(spark, distance):
    r = np.random.default_rng(distance)
    centres = r.integers(-(2**63), 2**63 - 1, 12)
    near = [int(c) ^ sum(1 << int(b) for b in r.choice(63, r.integers(0, distance + 2), replace=False)) for c in centres for _ in range(9)]
    fps = sorted({*map(int, centres), *near})
    df = spark.createDataFrame([(f, f) for f in fps], "node long, fp long")
    from corvina.operators.components import connected_components

    found = {x.node: x.component for x in connected_components(simhash_dedup.links(df, distance, block=4), "a", "b").collect()}
    want = _components(len(fps), lambda i, j: ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= distance)
    assert {f: found.get(f, f) for f in fps} == {f: fps[w] for f, w in zip(fps, want, strict=True)}


def test_similar_texts_meet(spark):
    base = prose(300).split()
    other = [w if i % 60 else "changed" for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(other)), (3, prose(300)), (4, prose(300)), (None, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in simhash_dedup.keep_one_of_each(df).collect()) == ["1", "3", "4", "None"]


def test_similar_texts_equal_brute_force(spark):
    """Pairs just above and well below a similarity of 0.8, and texts whose repeats outweigh what they share."""
    texts = []
    for k in range(60):
        own = [f"w{k}x{i}" for i in range(204)]
        run = (14, 18, 19, 22, 26, 31)[k % 6]  # a run of so many other words touches four more of 200 shingles
        texts += [" ".join(own), " ".join([*own[:60], *[f"v{k}x{i}" for i in range(run)], *own[60 + run :]])]
    texts += [("same old line here now " * 60) + " ".join(f"t{k}x{i}" for i in range(40)) for k in range(3)] + ["", None, " "]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    parts = _components(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash_dedup.keep_one_of_each(df).collect()}
    assert kept == {i for i in range(len(texts)) if parts[i] == i}


def test_packing(spark, docs, none):
    library = Encoder(BYTE).library
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for i, t in enumerate(TEXTS)}
    rows = packing.pack_documents(docs, BYTE).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    for d, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(ids[d])
    assert set(by_doc) == set(ids)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack_documents(none, BYTE).count() == 0


def test_first_fit_decreasing_equals_the_plain_loop():
    lengths = [rng.randint(1, 100) for _ in range(300)]
    bins: list[list[int]] = []
    for i in sorted(range(300), key=lambda i: -lengths[i]):
        for b in bins:
            if sum(lengths[j] for j in b) + lengths[i] <= 100:
                b.append(i)
                break
        else:
            bins.append([i])
    assert packing.first_fit_decreasing(lengths, 100) == bins


def test_suffix_arrays():
    for trial in range(150):
        k = rng.choice([1, 2, 3, 256])
        b = bytes(rng.randrange(k) for _ in range(rng.randint(1, 70))) * rng.choice([1, 1, 3])
        t = np.frombuffer(b, np.uint8)
        sa = suffix_sort.suffix_array(t)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        plcp = suffix_sort.permuted_common_prefixes(t, sa, 50)
        for x, y in zip(sa, sa[1:], strict=False):
            n = 0
            while n < 50 and max(x, y) + n < len(b) and b[x + n] == b[y + n]:
                n += 1
            assert plcp[y] == n


def _brute_repeats(rows, width=50):
    first = {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, b in raw:
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            first[w] = min(first.get(w, d), d)
    out = {}
    for d, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < d:
                gone[p : p + width] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("limits", [{}, {"block_bytes": 3_000}, {"block_bytes": 1_000, "hot": 3}])
def test_repeated_strings(spark, docs, limits):
    """Also with texts longer than a block, and with frequent anchors sent as single windows."""
    before = {t.name for t in spark.catalog.listTables()}
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(docs, **limits).collect()}
    assert got == _brute_repeats(list(enumerate(TEXTS)))
    assert {t.name for t in spark.catalog.listTables()} == before


def test_texts_without_repeats(spark, docs, none):
    assert suffix_dedup.digests(none).count() == 0
    cut = suffix_dedup.without_repeats(docs)
    assert cut.columns == docs.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[0] is None and texts[12] == "" and texts[7] == "x "


def test_repeated_ids_take_nothing_from_each_other(spark):
    df = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (None, PASSAGE)], "doc_id long, text string")
    assert sorted((str(r.id), r.n_removed == r.n_bytes) for r in suffix_dedup.digests(df).collect()) == [("1", False), ("1", False), ("None", True)]


def test_prefix_bpe_equals_the_library(spark, docs, none):
    library = Encoder(WORD).library
    got = {r.id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in prefix_bpe.encode_decode(docs, WORD).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), t
    assert prefix_bpe.encode_decode(none, WORD).count() == 0


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encodings_of_odd_texts(path):
    tool = Encoder(path)
    odd = TEXTS[1:] + ["".join(rng.choice([*" \n\tab'sB.1é— İΣ日<|É²½«-_~", "<|ENDOFTEXT|>", "<|endoftext|>", "word", " The", " don't", "\u017f"]) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    want = [tool.library.encode(t, add_special_tokens=False).ids for t in odd]
    assert [x.tolist() for x in tool.encode_all(odd)] == want
    bpe = prefix_bpe.PrefixBPE(path)
    assert [bpe.encode(t) for t in odd] == want
    assert [bpe.digest(t)[2] for t in odd] == [tool.library.decode(ids, skip_special_tokens=False) for ids in want]
    assert [bpe.decode(ids[1:-1]) for ids in want] == [tool.library.decode(ids[1:-1], skip_special_tokens=False) for ids in want]


def test_token_files(spark, docs, none, tmp_path):
    library = Encoder(WORD).library
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") for t in TEXTS]
    manifest = token_files.write_ids(docs, WORD, f"file://{tmp_path}/ids")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_digests(manifest).collect()}
    starts = np.cumsum([0, *map(len, ids)])
    assert got == {i: (starts[i], len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)}
    some = {r.doc_id: list(r.ids) for r in token_files.read_documents(manifest, [0, 11, 999]).collect()}
    assert some == {0: [2], 11: ids[11].tolist()}
    assert token_files.read_digests(token_files.write_ids(none, WORD)).count() == 0


@pytest.fixture(scope="module")
def repeats_and_nulls(spark):
    """Repeated ids with other and with equal texts, and null ids."""
    rows = [(1, prose(50)), (1, prose(20)), (1, "same"), (1, "same"), (None, "lone words"), (None, None), (2, PASSAGE), (2, PASSAGE)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows


def test_token_files_take_repeated_and_null_ids(spark, repeats_and_nulls):
    df, rows = repeats_and_nulls
    library = Encoder(WORD).library
    want = collections.Counter((d, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes())) for d, t in rows)
    manifest = token_files.write_ids(df, WORD)
    got = token_files.read_digests(manifest).orderBy("start").collect()
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in got) == want
    assert [r.doc_id for r in got] == [None, None, 1, 1, 1, 1, 2, 2]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    assert sorted(r.doc_id for r in token_files.read_documents(manifest, [0, 1]).collect()) == [1] * 4


def test_packing_takes_repeated_and_null_ids(repeats_and_nulls):
    df, rows = repeats_and_nulls
    library = Encoder(BYTE).library
    lengths = collections.Counter((d, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in rows)
    got = packing.pack_documents(df, BYTE).collect()
    assert collections.Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == lengths
    assert sum(r.length for r in got) == sum(n * c for (_, n), c in lengths.items())


def test_damaged_frames_are_noticed(tmp_path):
    from pyarrow import fs

    place = str(tmp_path / "x.zst")
    with open(place, "wb") as f:
        out = token_files.FrameWriter(f)
        out.frame(b"abc" * 50)
        out.finish()
    local = fs.LocalFileSystem()
    with local.open_input_file(place) as f:
        reader = token_files.FrameReader(f)
        assert reader.frame(0) == b"abc" * 50
        reader.table = reader.table.copy()
        reader.table[0, 2] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            reader.frame(0)


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 16))
    x[100:120] = x[100] + r.normal(0, 0.05, (20, 16))
    x[200:205] = x[200]
    rows = [(i, [float(v) for v in np.float32(row)], 1, "p") for i, row in enumerate(x)]
    rows += [(1000, None, 1, "p"), (1020, [0.0] * 16, 1, "p"), (1001, [float("nan")] + [1.0] * 15, 1, "p"), (1002, [None] + [1.0] * 15, 1, "p"), (1040, [1.0] * 3, 1, "p"), (1003, [float("inf")] * 16, 1, "p"), (1004, [], 1, "p")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int, pivot string")
    return df, np.array([row[1] for row in rows[:400]], dtype=np.float64)


def test_curve_search(spark, vectors):
    df, x = vectors
    rows = curve_search.search(df).collect()
    hits = total = 0
    for q in range(0, 400, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(400), -s))[:20]
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and all(abs(r.score - x[q] @ x[r.id]) < 1e-9 for r in mine)
        assert [(-r.score, r.id) for r in mine] == sorted((-r.score, r.id) for r in mine)
        hits += len(set(want) & {r.id for r in mine})
        total += 20
    assert hits / total >= 0.9 and {r.query_id for r in rows} == set(range(0, 400, 20))
    assert curve_search.search(df.limit(0)).count() == 0
    few = curve_search.search(df.where("vec_id < 3")).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2)]


def test_curve_search_recall_with_clusters_and_unequal_norms(spark):
    """Clustered vectors of very different lengths: recall by inner product, and windows that leave most rows out."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(60, 16))
    x = (centres[r.integers(0, 60, 3_000)] + r.normal(0, 0.15, (3_000, 16))) * r.lognormal(0, 0.5, 3_000)[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for row in curve_search.search(df, every=20, k=10).collect():
        got[row.query_id].add(row.id)
        assert row.score == float(np.einsum("ij,ij->i", x[[row.query_id]], x[[row.id]])[0])
    hits = 0
    for q in range(0, 3_000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s, kind="stable")[:10].tolist()))
    assert hits >= 0.9 * 10 * 150


def test_curve_search_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 0.1 * (i % 3), 0.7]) for i in range(300)]
    got = curve_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect()
    for q in range(0, 300, 20):
        mine = sorted((r.rank, r.id) for r in got if r.query_id == q)
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-(1 + 0.01 * (q % 3) * (i % 3) + 0.49), i))[:5]
        if q % 3:
            assert [i for _, i in mine] == best


def test_hilbert_keys_visit_neighbours():
    cells = np.array([[i, j, k] for i in range(8) for j in range(8) for k in range(8)])
    order = np.argsort(curve_search.hilbert_keys(cells, 3))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("block", [7, 1000])
def test_pivot_dedup(spark, vectors, block):
    df, x = vectors
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in pivot_dedup.near_duplicates(df, block=block).collect()}
    parts = _components(400, lambda i, j: near[i, j])
    assert {i: got[i] for i in range(400)} == {i: (int(near[i].sum()) - 1, parts[i], parts[i] == i) for i in range(400)}
    assert all(got[i] == (0, i, True) for i in (1000, 1020, 1001, 1002, 1040, 1003, 1004)) and len(got) == 407
    assert pivot_dedup.near_duplicates(df.limit(0)).count() == 0


def test_pivot_dedup_finds_the_links_of_a_large_group(spark, monkeypatch):
    """A third of the vectors are distinct near copies of one; the rest are unlike each other."""
    monkeypatch.setattr(pivot_dedup, "LIST", 35)  # as many pivots as a large table has
    r = np.random.default_rng(5)
    x = r.normal(size=(4_500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:1_500] = x[0] + 0.23 * x[:1_500]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    true = (x @ x.T >= 0.9).sum(axis=1) - 1
    got = {r.id: r for r in pivot_dedup.near_duplicates(df).collect()}
    assert true[1:1_500].min() > 1_000 and sum(r.n_links for r in got.values()) >= 0.98 * true.sum()
    assert all(r.n_links <= true[i] for i, r in got.items())
    assert {r.component_id for i, r in got.items() if i < 1_500} == {0} and sum(r.kept for r in got.values()) == 3_001


def test_quality(spark, none):
    good = [prose(rng.randint(20, 200)) for _ in range(150)]
    bad = [" ".join([rng.choice(WORDS)] * 60) for _ in range(40)] + [" ".join(w + "!!" for w in prose(50).upper().split()) for _ in range(40)]
    rows = [(i, t, int(i < 150)) for i, t in enumerate(good + bad)]
    rows += [(900, None, 0), (901, "", 0), (902, prose(3), None)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows] + [(0, 1, 0), (5000, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.id: r for r in quality.classify(df, labels).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in got}
    assert len(got) == len(rows) and all(r.held_out == held[i] and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    right = [got[i].predicted == q for i, _, q in rows[:230] if held[i]]
    assert sum(right) / len(right) > 0.9
    assert quality.keep_good(df, labels).columns == ["doc_id", "text"]
    assert quality.classify(none, labels).count() == 0
    assert {r.score for r in quality.classify(df, labels.limit(0)).collect()} == {0.5}


def test_language_model(spark, docs, none):
    held = quality.held_out(F.col("doc_id"), 7)
    got = {r.id: r for r in lm_score.score_documents(docs, ~held).collect()}
    counts = collections.Counter()
    for i, t in enumerate(TEXTS):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*_words(t), None])
    total = sum(counts.values())
    for i, t in enumerate(TEXTS):
        tokens = [*_words(t), None]
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in tokens)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    assert lm_score.score_documents(none, F.lit(True)).count() == 0
    blind = lm_score.score_documents(docs, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in blind} == {(0, 0, 0.0)}


def _step_by_step(model, tokens, start):
    """The natural log probability of a token sequence by the model's equations, one token at a time in double precision."""
    w = {n: x.astype(np.float64) for n, x in zip(model.NAMES, model.weights(), strict=True)}
    width, h, before, out = model.width, np.zeros(model.width), start, 0.0
    for token in tokens:
        x, g = w["embed"][before] @ w["wx"] + w["bias"], h @ w["wh"]
        z, r = (1 / (1 + np.exp(-(x[k * width : (k + 1) * width] + g[k * width : (k + 1) * width]))) for k in (0, 1))
        n = np.tanh(x[2 * width :] + r * g[2 * width :])
        h = (1 - z) * n + z * h
        k = model.class_of[token]
        members = np.flatnonzero(model.class_of == k)
        classes, words = np.exp(h @ w["class_w"] + w["class_b"]), np.exp(w["word_w"][members] @ h + w["word_b"][members])
        out += math.log(classes[k] / classes.sum() * words[list(members).index(token)] / words.sum())
        before = token
    return out


@pytest.mark.parametrize("bounds", [(4_096, 65_536), (20, 30)])
def test_model_scores_equal_a_step_by_step_evaluation(spark, docs, monkeypatch, bounds):
    """Also with a small vocabulary and few known counts, so that words meet their counts by the join."""
    monkeypatch.setattr(lm_score, "VOCABULARY", bounds[0])
    monkeypatch.setattr(lm_score, "KNOWN", sum(bounds))
    held = quality.held_out(F.col("doc_id"), 7)
    lm = lm_score.LanguageModel(docs.where(~held))
    got = {r.id: r.score for r in lm_score.score_with(lm, docs).collect()}
    counts = {bytes(r.word): r.c for r in lm.counts.collect()}
    head = lm.vocab.number
    assert head and (bounds[0] > 100 or (len(head) <= 20 and len(lm.known) <= 30))
    mass = collections.Counter({k: 1 for k in [*lm.vocab.ending.values(), lm.vocab.other]})
    for w, c in counts.items():
        if w not in head:
            mass[lm.vocab.tail(w)] += c + 1
    for i, t in enumerate(TEXTS):
        words = lm_score.words_of((t or "").encode())
        want = _step_by_step(lm.model, lm.vocab.encode(words).tolist(), lm.vocab.end) / math.log(10)
        want += sum(math.log10((counts.get(w, 0) + 1) / mass[lm.vocab.tail(w)]) for w in words if w not in head)
        assert abs(got[i] - want) < 1e-4 * max(1, abs(want)), i


def test_held_out_texts_are_likelier_than_by_counts(spark):
    """By a tenth of log10 for each token at least, whatever the partitioning; equally common words don't switch the model off."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = quality.held_out(F.col("doc_id"), 7)
    sums = lm_score.score_documents(df, ~held).where(quality.held_out(F.col("id"), 7)).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert sums[0] / sums[2] > sums[1] / sums[2] + 0.1
    again = lm_score.score_documents(df.repartition(7), ~held).where(quality.held_out(F.col("id"), 7)).agg(F.sum("score")).first()
    assert abs(again[0] - sums[0]) < 1e-4 * abs(sums[0])


def test_commonest_words_of_a_flat_distribution(spark):
    counts = spark.createDataFrame([(b"w%d" % i, 3 if i % 5 else 4) for i in range(2_000)] + [(b"top", 9)], "word binary, c long")
    found = lm_score._commonest(counts, 1_000)
    assert 900 < len(found) <= 1_000 and bytes(found[0].word) == b"top" and sum(r.c == 4 for r in found) == 400
    assert len(lm_score._commonest(counts, 5_000)) == 2_001


def test_every_training_token_is_learnt_from_once(spark, docs, monkeypatch):
    from corvina.llm.gru import Gru

    seen = []
    monkeypatch.setattr(Gru, "_train", lambda self, goal, *_: seen.append(goal.size))
    Gru(np.ones(9)).train(np.zeros(100_003, dtype=np.int32), 0)
    Gru(np.ones(9)).train(np.zeros(5, dtype=np.int32), 0)
    assert sum(seen) == 100_008


def test_language_model_takes_repeated_and_null_ids(spark, repeats_and_nulls):
    df, rows = repeats_and_nulls
    got = lm_score.score_documents(df, F.lit(True)).collect()
    assert sorted((str(r.id), r.n_tokens) for r in got) == sorted((str(d), len(_words(t)) + 1) for d, t in rows)
    assert {r.n_tokens - r.n_known for r in got} == {0}


def test_gru_is_a_distribution_and_learns():
    counts = np.array([50, 40, 30, 5, 4, 3, 2, 1], dtype=float)
    model = gru.Gru(counts, classes=3, width=8)
    states = np.random.default_rng(1).normal(size=(4, 8)).astype(np.float32)
    for h in states:
        assert abs(np.exp(model.log_probs(np.repeat(h[None], 8, axis=0), np.arange(8))).sum() - 1) < 1e-5
    tokens = np.tile([0, 3, 1, 5, 2, 7], 3_000)
    before = model.score([tokens[:600]], 0)[0]
    model.train(tokens, 0, streams=8)  # once
    assert model.score([tokens[:600]], 0)[0] > 0.3 * before
    texts = [tokens[:n] for n in (1, 70, 64, 300)]
    apart = [model.score([t], 0)[0] for t in texts]
    assert np.allclose(model.score(texts, 0), apart, rtol=1e-4)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in now.select("doc_id").collect()}
        now = spark.createDataFrame(stage(spark, now, sf_dir).collect(), documents.schema)
        assert now.columns == documents.columns and {r.doc_id for r in now.collect()} <= before, name
    texts = {r.doc_id: r.text for r in now.collect()}
    library = Encoder(BYTE).library
    got = collections.Counter()
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r.doc_id] += r.length
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
