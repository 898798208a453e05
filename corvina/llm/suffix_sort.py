"""Suffix arrays by induced sorting, with whole buckets per step, and common prefixes in text order."""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour's; the empty suffix at the end is smallest."""
    n = len(t)
    rise = np.zeros(n, dtype=np.int8)
    rise[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1].astype(np.int16))
    rise[-1] = -1
    at = np.where(rise != 0, np.arange(n), n)
    return rise[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _deal(lists: list, chars: np.ndarray, positions: np.ndarray) -> None:
    """Appends positions to the lists of their characters, in order."""
    order = np.argsort(chars, kind="stable")
    chars, positions = chars[order], positions[order]
    cut = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    for c, part in zip(chars[np.concatenate([[0], cut])], np.split(positions, cut), strict=True):
        lists[c].append(part)


def _induce(t: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from the leftmost-smaller ones in the order given.

    A bucket is one first character. Larger-typed suffixes are induced left to right and the smaller-typed ones right to
    left; within a bucket, the suffixes that put others into the same bucket are taken in waves, first come first served.
    """
    n = len(t)
    empty = np.zeros(0, dtype=np.int64)
    larger: list[list] = [[] for _ in range(256)]
    held: list[list] = [[] for _ in range(256)]
    if len(seeds):
        _deal(held, t[seeds], seeds)
    larger[t[n - 1]].append(np.array([n - 1]))
    left: list[np.ndarray] = [empty] * 256
    for c in range(256):
        waves = []
        now = np.concatenate(larger[c]) if larger[c] else empty
        while len(now):
            waves.append(now)
            before = now[now > 0] - 1
            before = before[~small[before]]
            chars = t[before]
            same = chars == c
            if not same.all():
                _deal(larger, chars[~same], before[~same])
            now = before[same]
        left[c] = np.concatenate(waves) if waves else empty
        if held[c]:
            seed = np.concatenate(held[c])
            before = seed[seed > 0] - 1
            if len(before):
                _deal(larger, t[before], before)
    smaller: list[list] = [[] for _ in range(256)]
    out: list[np.ndarray] = []
    for c in range(255, -1, -1):
        waves = []
        now = np.concatenate(smaller[c]) if smaller[c] else empty
        while len(now):
            waves.append(now)
            before = now[now > 0] - 1
            before = before[small[before]]
            chars = t[before]
            same = chars == c
            if not same.all():
                _deal(smaller, chars[~same], before[~same])
            now = before[same]
        if waves:
            out.append(np.concatenate(waves)[::-1])
        if len(left[c]):
            out.append(left[c])
            now = left[c][::-1]
            before = now[now > 0] - 1
            before = before[small[before]]
            if len(before):
                _deal(smaller, t[before], before)
    return np.concatenate(out[::-1])


def _doubled(names: np.ndarray) -> np.ndarray:
    """The suffix array of a string over a large alphabet: ranks of doubled length until all differ."""
    n, rank, step = len(names), names.astype(np.int64), 1
    while True:
        after = np.full(n, -1, dtype=np.int64)
        after[: n - step] = rank[step:] if step < n else []
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        rank, step = new, 2 * step
        if rank[order[-1]] == n - 1:
            return order


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of a byte array in ascending order."""
    if len(t) < 2:
        return np.arange(len(t))
    small = _types(t)
    marks = np.flatnonzero(small[1:] & ~small[:-1]) + 1  # leftmost-smaller
    first = _induce(t, small, marks)
    if not len(marks):
        return first
    is_mark = np.zeros(len(t) + 1, dtype=bool)
    is_mark[marks] = True
    ordered = first[is_mark[first]]  # by their substrings
    number = np.zeros(len(t) + 1, dtype=np.int64)
    number[marks] = np.arange(len(marks))
    ends = np.append(marks[1:], len(t))  # of the substring from each mark up to the next, with the next's first byte
    length = ends - marks
    a, b = ordered[:-1], ordered[1:]
    same = length[number[a]] == length[number[b]]
    same &= (ends[number[a]] < len(t)) & (ends[number[b]] < len(t))
    live, k = np.flatnonzero(same), 0
    while len(live):
        live = live[length[number[a[live]]] >= k]
        equal = t[a[live] + k] == t[b[live] + k]
        same[live[~equal]] = False
        live, k = live[equal], k + 1
    names = np.empty(len(marks), dtype=np.int64)
    names[number[ordered]] = np.cumsum(np.concatenate([[0], ~same]))
    if names.max() + 1 < len(marks):
        ordered = marks[_doubled(names)]  # the recursion, on the string of names
    return _induce(t, small, ordered)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each suffix, in text order, how many bytes it shares with the one before it in the array, up to ``most``."""
    padded = np.concatenate([t, np.zeros(most + 8, dtype=np.uint8)])
    words = np.ndarray(len(t) + most, dtype="<u8", buffer=padded.data, strides=(1,))
    n = len(t)
    out = np.zeros(n, dtype=np.int32)
    a, b = sa[:-1], sa[1:]
    live = np.arange(n - 1)
    for at in range(0, most, 8):
        x = words[a[live] + at] ^ words[b[live] + at]
        part = x != 0
        low = x[part] & (~x[part] + np.uint64(1))
        out[b[live[part]]] = at + np.bitwise_count(low - np.uint64(1)) // 8
        live = live[~part]
    out[b[live]] = most
    room = np.minimum(n - sa[1:], n - sa[:-1])
    out[b] = np.minimum(np.minimum(out[b], room), most)
    return out
