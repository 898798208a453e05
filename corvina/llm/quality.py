"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of a bounded sample of labelled texts come from Spark; shallow randomised trees are grown on them. Every path
from a root to a node is a rule, a conjunction of thresholds. A logistic regression with a lasso penalty weighs the rules
and drops most; the rest are compiled into one Spark column expression, so that scoring is a projection over the whole
table with no Python and no shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.session import saved

#: Labelled rows that the ensemble is fitted on, at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
_OPS = {"<=": lambda c, x: c <= F.lit(x), ">": lambda c, x: c > F.lit(x)}


def _share(text: Column, pattern: str) -> Column:
    """The share of a text's characters that match a class."""
    n = F.length(text)
    return (n - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(n, F.lit(1))


def statistics(text: Column) -> dict[str, Column]:
    """Numbers about a text; all are defined for empty texts."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    lines = F.split(t, "\n")
    n_words, n_lines = F.greatest(F.size(words), F.lit(1)), F.size(lines)
    next_to = F.arrays_zip(words.alias("a"), F.slice(words, 2, 1 << 30).alias("b"))
    again = F.filter(next_to, lambda p: p["a"] == p["b"])
    return {
        "chars": F.log1p(F.length(t)),
        "words": F.log1p(F.size(words)),
        "word_length": F.length(t) / n_words,
        "wide": (F.octet_length(t) - F.length(t)) / F.greatest(F.length(t), F.lit(1)),
        "upper": _share(t, r"\p{Lu}+"),
        "digits": _share(t, r"\p{Nd}+"),
        "letters": _share(t, r"\p{L}+"),
        "blanks": _share(t, r"\s+"),
        "stops": _share(t, r"[.,;:?'\"()-]+"),
        "exclaims": _share(t, r"!+"),
        "bars": _share(t, r"\|+"),
        "symbols": _share(t, r"[*#$%&@^~<>{}=+\\/_\[\]]+"),
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "repeated_words": F.size(again) / n_words,
        "lines": F.log1p(n_lines),
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "line_length": F.log1p(F.length(t) / n_lines),
    }


STATISTICS = (
    "chars", "words", "word_length", "wide", "upper", "digits", "letters", "blanks", "stops", "exclaims", "bars", "symbols", "distinct_words",
    "repeated_words", "lines", "distinct_lines", "line_length",
)


def with_statistics(docs: DataFrame, text_col: str, prefix: str = "__s_") -> DataFrame:
    return docs.withColumns({prefix + k: c.cast("double") for k, c in statistics(F.col(text_col)).items()})


@dataclass(frozen=True)
class RuleModel:
    """A bias and weighted rules; a rule is a tuple of (statistic, "<=" or ">", threshold)."""

    bias: float
    rules: tuple[tuple[tuple[tuple[str, str, float], ...], float], ...] = field(default=())

    def column(self, prefix: str = "__s_") -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(_holds(rule, prefix), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def score(self, docs: DataFrame, text_col: str = "text", name: str = "score") -> DataFrame:
        """``docs`` with a column of this name, from 0 to 1. Null texts count as empty."""
        full = with_statistics(docs, text_col).withColumn(name, self.column())
        return full.drop(*["__s_" + k for k in STATISTICS])


def _holds(rule: tuple, prefix: str) -> Column:
    met = F.lit(True)
    for name, op, threshold in rule:
        met = met & _OPS[op](F.col(prefix + name), threshold)
    return met


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, least: int, rng: np.random.Generator) -> set[tuple]:
    """The conjunctions on all paths of randomised trees over the columns of x."""
    cuts = [np.unique(np.quantile(c, np.arange(1, 64) / 64, method="nearest")) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)  # bin <= k: value <= cuts[k]
    found: set[tuple] = set()
    some = max(1, x.shape[1] // 3)

    def grow(rows: np.ndarray, path: tuple, left: int) -> None:
        if path:
            found.add(tuple(sorted(path)))
        if not left or len(rows) < 2 * least:
            return
        best = (1e-12, None, None)
        for f in rng.choice(x.shape[1], some, replace=False):
            size = len(cuts[f]) + 1
            ones = np.cumsum(np.bincount(bins[rows, f], weights=y[rows], minlength=size))
            n = np.cumsum(np.bincount(bins[rows, f], minlength=size))
            total, hits = n[-1], ones[-1]
            nl, nr = n[:-1], total - n[:-1]
            ok = (nl >= least) & (nr >= least)
            if not ok.any():
                continue
            pl, pr = ones[:-1] / np.maximum(nl, 1), (hits - ones[:-1]) / np.maximum(nr, 1)
            gain = np.where(ok, nl * pl * pl + nr * pr * pr - hits * hits / total, 0)
            if gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
        _, f, k = best
        if f is None:
            return
        low, cut = bins[rows, f] <= k, float(cuts[f][k])
        grow(rows[low], (*path, (int(f), "<=", cut)), left - 1)
        grow(rows[~low], (*path, (int(f), ">", cut)), left - 1)

    for _ in range(trees):
        grow(rng.choice(len(x), max(1, len(x) * 6 // 10), replace=False), (), depth)
    return found


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights of least logistic loss plus penalty times the weights' absolute sum (accelerated proximal steps)."""
    n = len(x)
    base = math.log(y.mean() / (1 - y.mean()))
    w, bias = np.zeros(x.shape[1]), base
    probe = np.ones(x.shape[1] + 1)
    for _ in range(20):  # the largest eigenvalue, for the step
        z = x @ probe[:-1] + probe[-1]
        probe = np.append(x.T @ z, z.sum())
        top = np.linalg.norm(probe)
        probe /= top
    step = 4 * n / (1.05 * top)
    vw, vb, t = w.copy(), bias, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(x @ vw + vb))) - y
        nw = vw - step * (x.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * r.mean()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - bias)
        done = np.abs(nw - w).max(initial=0) < 1e-5
        w, bias, t = nw, nb, t2
        if done:
            break
    return float(bias), w


def _met(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, op, cut in rule:
        out &= x[:, f] <= cut if op == "<=" else x[:, f] > cut
    return out


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = SAMPLE, trees: int = 60, depth: int = 3, penalty: float = 0.0005, seed: int = 5,
) -> RuleModel:
    """A model from the labelled rows for which ``usable`` (a condition on the id) holds.

    Rows with null labels, and labels without a document, teach nothing; of labels that repeat an id the larger counts.
    With no labelled row the score is 0.5 everywhere, with labels of one kind it is their mean, at most 0.99.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__label"))
    known = known.where(F.col("__label").isin(0.0, 1.0) & F.col("__id").isNotNull() & usable).groupBy("__id").agg(F.max("__label").alias("__label"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    taught = F.broadcast(saved(chosen, "labels"))  # at most ``sample`` pairs of numbers
    rows = with_statistics(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(taught, "__id"), "__text")
    got = rows.select("__id", "__label", F.array(*["__s_" + k for k in STATISTICS]).alias("x")).limit(2 * sample).collect()
    got.sort(key=lambda r: (r[0], r[2]))
    y = np.array([r[1] for r in got])
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()), 0.01), 0.99) if len(y) else 0.5
        return RuleModel(math.log(share / (1 - share)))
    x = np.array([r[2] for r in got])
    rules = sorted(tree_rules(x, y, trees, depth, max(5, len(y) // 1_000), np.random.default_rng(seed)))
    kept: dict[bytes, tuple] = {}
    for rule in rules:  # of rules that hold for the same rows, the shortest
        mark = np.packbits(_met(rule, x)).tobytes()
        if mark not in kept or len(rule) < len(kept[mark]):
            kept[mark] = rule
    rules = list(kept.values())
    bias, weights = lasso_logistic(np.stack([_met(r, x) for r in rules], axis=1).astype(np.float32), y, penalty)
    named = [tuple((STATISTICS[f], op, cut) for f, op, cut in r) for r in rules]
    return RuleModel(bias, tuple((r, float(w)) for r, w in zip(named, weights, strict=True) if abs(w) > 1e-6))


def crc_of_id(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary"))


def held_out(id_col: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether the CRC-32 of the id as text leaves this remainder; null ids aren't held out."""
    return F.coalesce(F.pmod(crc_of_id(id_col), F.lit(parts)) == part, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Rows (id, held_out, score, predicted), one for each row of docs, from labels of rows that aren't held out.

    Scores depend on the text alone: equal texts score the same, null texts as empty ones. An empty table gives an empty
    result.
    """
    model = fit(docs, labels, ~held_out(F.col("__id")), id_col, text_col)
    scored = model.score(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text")), "__text")
    return scored.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows that score below the threshold."""
    model = fit(docs, labels, ~held_out(F.col("__id")), id_col, text_col)
    return model.score(docs, text_col, "__score").where(F.col("__score") >= threshold).drop("__score")
