"""Compiled quality rules against statistics and rules evaluated in plain Python."""

import math

import pytest

pytest.importorskip("public_tokenizers")
regex = pytest.importorskip("regex")

from pyspark.sql import functions as F  # noqa: E402

from corvina.llm import quality  # noqa: E402

LONG = "One long line of words, again and again! " * 4_000
TEXTS = [
    None, "", " ", "\n\n", "word", "word word", "Two Lines.\nTwo Lines.", "ÉCOLE été 日本語 🎉🎉", "a|b|c || #hash $5 100% {x} [y] _z_", "!!! wow !!!", "x" * 3_000, LONG,
    "1,234.56 and 7 ٣", "tab\tvt\x0bff\fcr\r end", "nbsp stays one word", "it's (fine): \"quoted\"; yes?",
]


def plain(text):
    t = text or ""
    words = [w for w in regex.split(r"[ \t\n\x0B\f\r]+", t) if w]
    lines = t.split("\n")
    n_words = max(len(words), 1)

    def share(pattern):
        return (len(t) - len(regex.sub(pattern, "", t))) / max(len(t), 1)

    return {
        "chars": math.log1p(len(t)), "words": math.log1p(len(words)), "word_length": len(t) / n_words, "wide": (len(t.encode()) - len(t)) / max(len(t), 1), "upper": share(r"\p{Lu}+"),
        "digits": share(r"\p{Nd}+"), "letters": share(r"\p{L}+"), "blanks": share(r"[ \t\n\x0B\f\r]+"), "stops": share(r"[.,;:?'\"()-]+"), "exclaims": share("!+"), "bars": share(r"\|+"),
        "symbols": share(r"[*#$%&@^~<>{}=+\\/_\[\]]+"), "distinct_words": len(set(words)) / n_words, "repeated_words": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n_words,
        "lines": math.log1p(len(lines)), "distinct_lines": len(set(lines)) / len(lines), "line_length": math.log1p(len(t) / len(lines)),
    }


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, 0.5, "clash") for i, t in enumerate([*TEXTS, *TEXTS[:4]])]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, words string").repartition(3)


def test_statistics_equal_plain_python(texts):
    rows = quality.with_statistics(texts, "text").collect()
    for r in rows:
        want = plain(r.text)
        for name in quality.STATISTICS:
            assert math.isclose(r["__s_" + name], want[name], rel_tol=1e-9, abs_tol=1e-12), (name, r.text and r.text[:30])


def test_compiled_scores_equal_plain_rules(texts):
    """Rules on every statistic, at values that some text has exactly, so that both sides of a threshold count."""
    known = [plain(t) for t in TEXTS]
    rules = []
    for k, name in enumerate(quality.STATISTICS):
        values = sorted({s[name] for s in known})
        cut, other = values[len(values) // 2], quality.STATISTICS[(k + 5) % 17]
        rules += [(((name, "<=", cut),), 0.3 + k / 50), (((name, ">", cut), (other, "<=", sorted(s[other] for s in known)[8])), -0.4 + k / 60)]
    model = quality.RuleModel(0.1, tuple(rules))
    near = 1e-9
    for r in model.score(texts.drop("score"), "text").collect():
        s, total, sure = plain(r.text), 0.1, True
        for rule, weight in rules:
            sure &= all(abs(s[n] - c) > near or s[n] == c for n, _, c in rule)
            total += weight if all(s[n] <= c if op == "<=" else s[n] > c for n, op, c in rule) else 0
        assert not sure or math.isclose(r.score, 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_a_score_at_the_threshold_is_kept(texts, monkeypatch):
    monkeypatch.setattr(quality, "fit", lambda *_, **__: quality.RuleModel(0.0))
    assert {(r.score, r.predicted) for r in quality.classify(texts, texts, threshold=0.5).collect()} == {(0.5, 1)}
    assert {r.predicted for r in quality.classify(texts, texts, threshold=0.5 + 1e-12).collect()} == {0}
    kept = quality.keep_good(texts, texts, threshold=0.5)
    assert kept.columns == texts.columns and kept.count() == len(TEXTS) + 4


def test_repeated_ids_score_by_their_texts(texts, spark):
    labels = spark.createDataFrame([(0, 0), (0, 1), (6, 1), (10, 0), (None, 1)], "doc_id long, quality int")
    twice = texts.union(texts).withColumn("doc_id", F.col("doc_id") % 3)
    by_text = {}
    for r in quality.classify(twice.withColumn("t", F.col("text")), labels).collect():
        by_text.setdefault(r.id, set()).add(round(r.score, 12))
        assert 0 <= r.score <= 1
    assert len(by_text) == 3
