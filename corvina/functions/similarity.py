"""String similarity over whole batches of pairs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a pattern that one machine word holds.
WORD = 64
#: Pairs that are compared at a time.
AT_ONCE = 50_000


def _codes(strings: Sequence[str]) -> tuple[np.ndarray, int]:
    """A row of character numbers for each string, filled up with 0; and the numbers' count."""
    lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    known, number = np.unique(flat, return_inverse=True)
    out = np.zeros((len(strings), int(lengths.max(initial=0))), dtype=np.int32)
    row = np.repeat(np.arange(len(strings)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = number + 1
    return out, len(known) + 1


#: Characters of strings whose bags are matrices.
BAG = 256


def bags(strings: Sequence[str]) -> np.ndarray | None:
    """A row for each string, a column for each character and its how-manieth occurrence; None where strings are long.

    The product of two rows is the number of characters in common, in any order: no common subsequence is longer.
    """
    text, _ = _codes(strings)
    if text.shape[1] > BAG:
        return None
    text = np.sort(text, axis=1)
    at = np.broadcast_to(np.arange(text.shape[1]), text.shape)
    begins = np.ones(text.shape, dtype=bool)
    begins[:, 1:] = text[:, 1:] != text[:, :-1]
    token = text.astype(np.int64) * BAG + (at - np.maximum.accumulate(np.where(begins, at, 0), axis=1))
    row, column = np.nonzero(text)
    known, number = np.unique(token[row, column], return_inverse=True)
    out = np.zeros((len(strings), len(known)), dtype=np.float32)
    out[row, number] = 1
    return out


def pieces(offered: Sequence[str], held: Sequence[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """A row for each string that is a list of pieces of so many characters, and for each string that may hold such pieces."""
    lists = [{s[k : k + width] for k in range(0, len(s), width)} for s in offered]
    known = {w: k for k, w in enumerate(sorted(set().union(*lists)))}
    holds = [{s[k : k + width] for k in range(len(s) - width + 1)} & known.keys() for s in held]
    out = []
    for rows in (lists, holds):
        matrix = np.zeros((len(rows), len(known)), dtype=np.float32)
        at = np.fromiter((known[w] for own in rows for w in own), dtype=np.int64)
        matrix[np.repeat(np.arange(len(rows)), [len(own) for own in rows]), at] = 1
        out.append(matrix)
    return out[0], out[1]


def _long_lcs(a: str, b: str) -> int:
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    v = every
    for c in b:
        u = v & places.get(c, 0)
        v = ((v + u) | (v - u)) & every
    return len(a) - v.bit_count()


def lcs_lengths(strings: Sequence[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of strings[i] and strings[j], for each pair.

    Bits of a word stand for the characters of the first string of a pair, and a step takes one character of all second
    strings; pairs whose shorter string doesn't fit a word are compared one by one, with longer words.
    """
    lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    swap = lengths[i] > lengths[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    out = np.zeros(len(i), dtype=np.int64)
    fits = lengths[i] <= WORD
    for k in np.flatnonzero(~fits).tolist():
        out[k] = _long_lcs(strings[i[k]], strings[j[k]])
    pairs = np.flatnonzero(fits & (lengths[i] > 0))
    if not len(pairs):
        return out
    pairs = pairs[np.argsort(lengths[j[pairs]], kind="stable")]  # those of a chunk end together
    for at in range(0, len(pairs), AT_ONCE):
        some = pairs[at : at + AT_ONCE]
        own, a, b = *np.unique(i[some], return_inverse=True), j[some]
        other, b = np.unique(b, return_inverse=True)
        text, n = _codes([strings[x] for x in [*own, *other]])
        places = np.zeros((len(own), n), dtype=np.uint64)
        for k in range(min(WORD, text.shape[1])):
            places[np.arange(len(own)), text[: len(own), k]] |= np.uint64(1 << k)
        places[:, 0] = 0  # nothing ends in a match
        second = text[len(own) :, : int(lengths[other].max())]
        v = np.full(len(some), ~np.uint64(0))
        for k in range(second.shape[1]):
            u = v & places[a, second[b, k]]
            v = (v + u) | (v - u)
        kept = np.where(lengths[own] == WORD, ~np.uint64(0), (np.uint64(1) << (lengths[own] % WORD).astype(np.uint64)) - np.uint64(1))
        out[some] = lengths[own][a] - np.bitwise_count(v & kept[a]).astype(np.int64)
    return out


def _common(strings: Sequence[str]) -> tuple[int, int]:
    """How many characters all strings begin and end with; the two don't overlap in any of them."""
    low, high = min(strings), max(strings)
    shortest = min(map(len, strings))
    head = 0
    while head < shortest and low[head] == high[head]:
        head += 1
    tail = 0
    while tail < shortest - head and len({s[-1 - tail] for s in strings}) == 1:
        tail += 1
    return head, tail


def _set(good: np.ndarray) -> np.ndarray:
    """Places of what is true, which is little, eight at a time."""
    eights = np.flatnonzero(good.reshape(-1).view(np.uint64))
    k = np.flatnonzero(good.reshape(-1, 8)[eights])
    return 8 * eights[k >> 3] + (k & 7)


class Columns:
    """Longest common subsequences of many strings, given in sorted order, with each of other strings, all pairs at once.

    What all strings begin and end with counts for itself. Of the rest, beginnings that several strings share are compared
    once: a step takes one more character of all different beginnings, and bits of a word stand for the other string's
    characters, as in ``lcs_lengths``. Other strings that don't fit a word are compared pair by pair.
    """

    def __init__(self, strings: Sequence[str], others: Sequence[str], least: float):
        self.strings, self.others, self.least = strings, others, least
        self.head, self.tail = _common([*strings, *others])
        cut = [s[self.head : len(s) - self.tail] for s in (*strings, *others)]
        self.m, self.n = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (strings, others))
        self.bits = int(self.n.max()) - self.head - self.tail
        if self.bits > WORD:
            return
        # the shortest subsequence that reaches the ratio, by lengths of strings and of others, and where theirs are
        m, self.mine = np.unique(self.m, return_inverse=True)
        n, self.theirs = np.unique(self.n, return_inverse=True)
        both = m[:, None] + n
        want = np.maximum(np.ceil(both * least / 2).astype(np.int64) - 1, 0)
        while (short := 2 * want / np.maximum(both, 1) < least).any():
            want = want + short
        self.want = np.clip(want - self.head - self.tail, 0, 255).astype(np.uint8)
        codes, self.known = _codes(cut)
        text, self.rows = codes[: len(strings), : int(self.m.max()) - self.head - self.tail], codes[len(strings) :, : self.bits]
        self.steps = []  # of each number of characters: the beginnings, by the one before and the last character
        if not text.shape[1]:
            return
        new = np.ones(text.shape, dtype=bool)
        new[1:] = np.logical_or.accumulate(text[1:] != text[:-1], axis=1)
        before = np.zeros(len(text), dtype=np.int64)
        for k in range(text.shape[1]):
            first = np.flatnonzero(new[:, k])
            self.steps.append((before[first], text[first, k]))
            before = np.cumsum(new[:, k]) - 1
        self.last = before  # equal strings share their last beginning

    def alike(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, ratio) for others[lo:hi] and strings whose ratio is enough; i counts from the first of all others."""
        if self.bits > WORD:
            return self._one_by_one(lo, hi)
        word = next(w for w in (np.uint8, np.uint16, np.uint32, np.uint64) if self.bits <= np.iinfo(w).bits)
        places = np.zeros((self.known, hi - lo), dtype=word)
        for k in range(self.bits):
            places[self.rows[lo:hi, k], np.arange(hi - lo)] |= word(1 << k)
        places[0] = 0  # nothing ends in a match
        v = np.full((1, hi - lo), np.iinfo(word).max, dtype=word)
        for before, character in self.steps:
            v = v if len(before) == len(v) else v.take(before, axis=0)
            u = places.take(character, axis=0)
            u &= v
            w = v + u
            w |= v - u
            v = w
        got = np.bitwise_count(~v)  # a row for each beginning, a column for each of the others
        if len(got) < len(self.strings):
            got = got.take(self.last, axis=0) if self.steps else np.repeat(got, len(self.strings), axis=0)
        good = got >= (self.want[0, 0] if self.want.size == 1 else self.want[:, self.theirs[lo:hi]][self.mine])
        at = np.flatnonzero(good) if good.size % 8 else _set(good)
        j, i = np.divmod(at, hi - lo)
        return i + lo, j, 2 * (got[j, i].astype(np.int64) + self.head + self.tail) / np.maximum(self.n[i + lo] + self.m[j], 1)

    def _one_by_one(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        every = [*self.strings, *self.others[lo:hi]]
        bag = bags(every)
        k = len(self.strings)
        both = self.n[lo:hi, None] + self.m
        ok = np.minimum(self.n[lo:hi, None], self.m) * 2 / both >= self.least if bag is None else 2 * (bag[k:] @ bag[:k].T).astype(np.float64) / both >= self.least
        i, j = np.nonzero(ok)
        ratio = 2 * lcs_lengths(every, i + k, j) / both[i, j]
        good = ratio >= self.least
        return i[good] + lo, j[good], ratio[good]


def indel_ratios(strings: Sequence[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Twice the longest common subsequence over the summed lengths; two empty strings are equal."""
    lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    both = lengths[i] + lengths[j]
    return np.where(both == 0, 1.0, 2 * lcs_lengths(strings, i, j) / np.maximum(both, 1))


@F.pandas_udf(T.DoubleType())
def string_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of two columns, lower-cased; null counts as empty."""
    strings = [*(x.lower() if x else "" for x in a), *(x.lower() if x else "" for x in b)]
    n = np.arange(len(a))
    return pd.Series(indel_ratios(strings, n, n + len(a)))
