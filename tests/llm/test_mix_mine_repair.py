"""op11 to op13 against brute force, on small tables with odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from corvina.llm import conversation_repair as repairs  # noqa: E402
from corvina.llm import mixing, negatives, queries  # noqa: E402

from ..compare import connect, rows_of, sql_rows  # noqa: E402

rng = random.Random(11)


@pytest.mark.parametrize("name", ["op11_source_mix", "op12_hard_negatives", "op13_conversation_repair"])
def test_query_matches_sql(name, spark, sf_dir):
    if name not in queries.ORACLES:
        pytest.skip("no SQL")
    assert rows_of(queries.QUERIES[name](spark, sf_dir)) == sql_rows(connect(sf_dir), queries.ORACLES[name])


# mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def filled(sizes, weights, share, epochs):
    """Targets by the contract's words: clamp what is above, share again, until none is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    clamped, total = set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in clamped]
        left = total - sum(epochs * sizes[s] for s in clamped)
        level = left / sum(weight[s] for s in open_) if open_ else 0
        more = [s for s in open_ if level * weight[s] > epochs * sizes[s]]
        if not more:
            return {s: epochs * sizes[s] if s in clamped else level * weight[s] for s in names}
        clamped |= set(more)


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(i, " ".join(["wort"] * rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", "\U0001f600", "￮", None]), i) for i in range(400)]
    rows += [(None, None, "a", 0), (7, "", "empty", 0), (8, " \t\n", "empty", 0), (9, "long text " * 30_000, "b", 1)]
    rows += [(500, "the same row " * 5, "copies", 3)] * 40
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size long").repartition(5)


@pytest.mark.parametrize(("weights", "share", "epochs"), [((3, 1, 2), 1.5, 2), ((1, 5), 0.3, 1), ((2, 1), 3.0, 2), ((1, 9, 1), 2.5, 4.5)])
def test_mix_equals_brute_force(mixed, weights, share, epochs):
    rows, df = mixed
    found = mixing.mix(df, weights, share, epochs).collect()
    assert len(found) == len(rows)
    sizes = collections.Counter()
    for _, t, s, _ in rows:
        sizes[s] += words(t)
    targets, taken = filled(sizes, weights, share, epochs), collections.Counter()
    copies = collections.Counter(s for _, _, s, _ in rows)
    for r in found:
        assert r.source_size == sizes[r.source]
        assert math.isclose(r.target, min(targets[r.source], epochs * sizes[r.source]), rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= r.part <= r.size and r.taken == r.repeats * r.size + r.part <= math.ceil(epochs) * r.size
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert -copies[s] < n - min(targets[s], epochs * sizes[s]) <= 0.5 if s == "copies" else abs(n - min(targets[s], epochs * sizes[s])) <= 0.5
    # within a source documents are taken in the order of the hash
    by = collections.defaultdict(list)
    for r in found:
        by[r.source].append(r)
    for group in by.values():
        shares = [r.part / r.size for r in sorted(group, key=lambda r: r.h) if r.size]
        assert shares == sorted(shares, reverse=True)


def test_mix_reruns_agree_and_seeds_differ(mixed, spark):
    rows, df = mixed
    key = lambda r: tuple((x is None, x) for x in r)
    once = sorted(map(tuple, mixing.mix(df).collect()), key=key)
    assert once == sorted(map(tuple, mixing.mix(df.repartition(2)).collect()), key=key)
    assert once != sorted(map(tuple, mixing.mix(df, seed=2).collect()), key=key)


def test_mixed_documents_hold_the_taken_words(mixed):
    rows, df = mixed
    plan = {(r.id, r.source, r.size): r.taken for r in mixing.mix(df).collect()}
    got = collections.Counter()
    texts = {(i, s, words(t)): t for i, t, s, _ in rows}
    made = mixing.mixed_documents(df).collect()
    assert set(made[0].asDict()) == {*df.columns, "copy"}
    for r in made:
        match = [k for k in texts if k[:2] == (r.doc_id, r.source) and (texts[k] or "").startswith(r.text)]
        assert match
        got[match[0]] += words(r.text)
    equal = collections.Counter((i, s, words(t)) for i, t, s, _ in rows)
    assert {k: v for k, v in got.items() if k[0] != 9} == {k: v * equal[k] for k, v in plan.items() if v and k[0] != 9}
    assert {k[1]: v for k, v in got.items() if k[0] == 9} == {k[1]: v for k, v in plan.items() if v and k[0] == 9}


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0.0, 0)] * 2
    assert mixing.mixed_documents(blank).collect() == []


# hard negatives


def mined(rows, k, most, low, high, scale=256.0, anchor=lambda i: i % 10 == 0):
    good = [(i, lab, [math.floor(x * scale) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for n, (i, lab, v) in enumerate(good):
        if not anchor(i):
            continue
        scored = sorted((-dot(v, w), j, m) for m, (j, _, w) in enumerate(good) if m != n)
        for s, j, _ in [x for x in scored if good[x[2]][1] == lab][:k]:
            near = [(t, i2) for t, i2, m in scored if good[m][1] != lab and low * -s <= 100 * -t <= high * -s][:most]
            out += [(i, j, r, i2, -s, -t) for r, (t, i2) in enumerate(near, 1)]
    return sorted(out)


def vectors(n, dims, spread=1.0):
    made = []
    for i in range(n):
        v = [float(np.float32(rng.gauss(0, 1) * spread)) for _ in range(dims)]
        made.append((i, rng.randint(0, 3), v))
    return made


@pytest.mark.parametrize("case", ["plain", "ties", "odd", "wide"])
def test_negatives_equal_brute_force(spark, case):
    rows = vectors(150, 13)
    if case == "ties":
        rows = [(i, i % 3, rows[i % 7][2]) for i in range(120)] + [(20, 1, rows[3][2])] * 3
    if case == "odd":
        rows += [(200, None, rows[0][2]), (210, 1, None), (220, 2, [None] * 13), (230, 1, [float("nan")] * 13), (240, 0, [float("inf")] + [0.0] * 12), (250, 1, [0.0] * 13), (260, 2, []), (270, 1, rows[1][2][:5]), (None, 1, rows[2][2])]
    if case == "wide":
        rows = vectors(80, 24, 300.0)
    df = spark.createDataFrame([(*r, float(n), n) for n, r in enumerate(rows)], "vec_id long, label long, embedding array<double>, score double, uid long").repartition(4)
    found = negatives.mine(df, "id % 10 = 0", positives=4, negatives=6).collect()
    assert sorted(tuple(r) for r in found) == mined(rows, 4, 6, 30, 90)


def test_negatives_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    monkeypatch.setattr(negatives, "CANDIDATES", 20)
    rows = vectors(200, 8)
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    assert sorted(tuple(r) for r in negatives.mine(df, "id % 10 = 0").collect()) == mined(rows, 5, 10, 30, 90)
    assert negatives.mine(df, "false").collect() == [] and negatives.mine(df.where("false"), "true").collect() == []


def test_subset_sums_give_exact_inner_products():
    r = np.random.default_rng(3)
    a, c = r.integers(-300, 300, (9, 24)), r.integers(-511, 512, (40, 24))
    assert (negatives.scores(negatives.subset_sums(a, np.int64), negatives.pack(c, 10)) == c @ a.T).all()


def test_huge_components_are_bounded(spark):
    rows = [(0, 1, [1e300, 1.0]), (1, 1, [1e300, 0.0]), (2, 2, [5e299, 0.0]), (3, 2, [1.0, 1.0])]
    found = negatives.mine(spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>"), "id = 0").collect()
    assert all(0 < r.positive_score < 2**63 // 100 for r in found)


# conversations


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1]
            out.append("sound" if last in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """Cost, audit and lines by going over all edits, backwards, with the whole rest of the audit in hand."""
    marks = faults(rows)
    automaton = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    end = {"": (0, ""), "s": (6, "II"), "u": (3, "I"), "a": (0, "")}
    best = [end]
    for (role, _), mark in zip(reversed(rows), reversed(marks), strict=True):
        now, after = {}, best[-1]
        for q in ("", "s", "u", "a"):
            ways = [(4 + after[q][0], "D" + after[q][1])]
            if mark not in ("blank", "duplicate"):
                more = 3 * (mark == "truncated")
                if (to := automaton.get((q, role[:1]))) is not None:
                    ways.append((more + after[to][0], "K" + after[to][1]))
                ways += [(3 + more + after[to][0], "R" + after[to][1]) for x in "ua" if (to := automaton.get((q, x)))]
            now[q] = min(ways)
        for _ in range(4):
            for q in now:
                now[q] = min([now[q], *((3 + now[to][0], "I" + now[to][1]) for x in "ua" if (to := automaton.get((q, x))))])
        best.append(now)
    cost, audit = best[-1][""]
    lines, state, at = [], "", 0
    for letter in audit:
        role, text = rows[at] if letter != "I" else ("", "")
        at += letter != "I"
        if letter == "D":
            continue
        if letter == "K":
            state = role[0]
            lines.append(f"{role}:{text}")
        else:
            state = "a" if state == "u" else "u"
            lines.append(f"{'user' if state == 'u' else 'assistant'}:{text}")
    return cost, audit, "\n".join(lines)


def expected(table):
    every = collections.defaultdict(list)
    for conv, turn, role, text in table:
        every[conv]
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        every[conv] += [(turn, role, text)] * (2 if hit == 3 else 1)
    out = {}
    for conv, rows in every.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        turns = {r[0] for r in rows} - {None}
        plain = [r[1:] for r in rows]
        cost, audit, lines = brute(plain)
        marks = collections.Counter(faults(plain))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(plain))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, marks["blank"], marks["duplicate"], marks["truncated"], illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest())
    return out


def chat(n, conv, long=None):
    roles = ["user", "assistant", "system", "tool", "", None, "s", "assistant", "user"]
    texts = ["Yes.", "No", "Why?", " ", "", None, "a b!", "x\n.\t", "Sure. ", " ", "Well, " * 500, "x.\u0085", "\u2028"]
    return [(conv, (i if rng.random() < 0.9 else None if rng.random() < 0.3 else i - 2), rng.choice(roles[:3] if rng.random() < 0.9 else roles), rng.choice(texts) if rng.random() < 0.4 else f"Text {i}{rng.choice('.!?;')}") for i in range(long or n)]


def digests(spark, table, **_):
    df = spark.createDataFrame([(*r, 1, "z") for r in table], "conv_id long, turn long, role string, text string, place long, code string").repartition(4)
    summary, repaired = repairs.repair(repairs.damaged(df), originals=df)
    done = repairs.with_digests(summary, repaired).collect()
    assert len({r.conv for r in done}) == len(done)
    return {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in done}


def test_repair_equals_brute_force(spark):
    table = [r for conv in range(300) for r in chat(rng.randint(1, 12), conv)] + chat(30, None) + chat(1, 1000)
    table += [(2000, 1, "user", "Same.")] * 7 + [(2001, None, None, None)] * 3 + [(2002, -5, "system", "Only.")]
    assert digests(spark, table) == expected(table)


def test_repair_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(repairs, "CHUNK_BITS", 3)
    table = chat(0, 1, 700) + [r for conv in range(2, 30) for r in chat(rng.randint(1, 40), conv)] + chat(0, None, 90)
    assert digests(spark, table) == expected(table)


def test_fix_up_stops_where_vectors_differ_by_a_constant():
    codes = bytes(rng.choice(range(12)) for _ in range(3_000))
    start = repairs.run_back(codes, repairs.SPECULATIVE)
    for end in [repairs.END, (0, 3, 3, 0), (2, 1, 0, 3)]:
        assert repairs.run_back(codes, end, repairs.SPECULATIVE, start) == repairs.run_back(codes, end)


def test_repaired_rows_have_legal_roles(spark):
    table = [r for conv in range(60) for r in chat(rng.randint(1, 12), conv)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    _, repaired = repairs.repair(df)
    by = collections.defaultdict(list)
    for r in repaired.collect():
        by[r.conv].append((r.place, r.nth, r.role[0]))
    assert all(re.fullmatch("s?(ua)+", "".join(x[2] for x in sorted(rows))) for rows in by.values()) and by


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    summary, repaired = repairs.repair(empty)
    assert repairs.with_digests(summary, repaired).collect() == [] and repaired.collect() == []
    gone = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    summary, repaired = repairs.repair(gone.where("false"), originals=gone)
    assert [tuple(r) for r in repairs.with_digests(summary, repaired).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
