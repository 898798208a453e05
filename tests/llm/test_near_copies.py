"""The pipeline's SimHash stage on near copies that are planted in the documents."""

import random

import pytest

pytest.importorskip("public_tokenizers")

from corvina.llm import simhash_dedup  # noqa: E402


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_planted_near_copies_go_and_others_stay(spark):
    """Copies have as many words changed as five-word shingles with a similarity of 0.8 allow, and fewer; nine of ten go at least."""
    rng = random.Random(9)
    own = [(r.doc_id, r.text.split()) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect() if r.text and 60 <= len(r.text.split()) <= 2_000][:350]
    planted, far = {}, {}
    for doc, words in own:
        most = (len(words) - 4) // 45
        changed = list(words)
        for _ in range(rng.randint(1, max(1, most))):
            kind, at = rng.randrange(3), rng.randrange(len(changed))
            changed[at : at + 1] = {0: [f"new{rng.randrange(10**6)}"], 1: [], 2: [changed[at], "added"]}[kind]
        (planted if similarity(words, changed) >= 0.8 else far)[doc + 10**6] = (doc, changed)
    rows = [(d, " ".join(w)) for d, w in own] + [(d, " ".join(w)) for d, (_, w) in [*planted.items(), *far.items()]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    kept = {r.doc_id for r in simhash_dedup.keep_one_of_each(df).select("doc_id").collect()}
    assert len(planted) > 250
    assert sum(d not in kept for d in planted) >= 0.9 * len(planted)
    alone = {r.doc_id for r in simhash_dedup.keep_one_of_each(df.where("doc_id < 1000000")).select("doc_id").collect()}
    assert {d for d in kept if d < 10**6} == alone


def test_a_family_below_the_similarity_costs_a_forest(spark, monkeypatch):
    """Texts that are alike but mostly below 0.8 are offered as a forest, not as all pairs; what stays is what all pairs say."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(3_000)}" for _ in range(300)]
    family = [[w if rng.random() > 0.025 else f"x{rng.randrange(10**6)}" for w in base] for _ in range(110)]
    family += [[*family[k][:-3], "an", "other", "end"] for k in range(0, 30, 3)]
    root = list(range(len(family)))
    for i in range(len(family)):
        for j in range(i):
            if root[i] != root[j] and similarity(family[i], family[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(family)], "doc_id long, text string").repartition(5)
    offered, whole = [], simhash_dedup.similar_between

    def counted(rows, *args):
        offered.append(rows.count())
        return whole(rows, *args)

    monkeypatch.setattr(simhash_dedup, "similar_between", counted)
    for most in (500, 15):  # one block, and many
        monkeypatch.setattr(simhash_dedup, "MEET_NODES", most)
        assert {r.doc_id for r in simhash_dedup.keep_one_of_each(df).collect()} == set(root)
    assert len(set(root)) < len(family) - 9
    # every group of fingerprints tells a forest: at most one edge for each member, of which each is in 9 for each fingerprint
    assert max(offered) < 40 * len(family) and len(offered) == 2
