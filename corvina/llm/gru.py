"""A gated recurrent language model in numpy with a class-factored output."""

from __future__ import annotations

import heapq

import numpy as np


def make_classes(counts: np.ndarray, classes: int) -> np.ndarray:
    """First token of each class, and the number of tokens at the end; tokens come by falling count.

    Classes have about equal sums of the counts' square roots, so frequent tokens are in small classes.
    """
    mass = np.cumsum(np.sqrt(counts + 1.0))
    cuts = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes, side="right")
    return np.unique(np.concatenate([[0], cuts, [len(counts)]]))


class Gru:
    """Weights and the two passes. A token's probability is that of its class times that of the token in its class."""

    NAMES = ("embed", "wx", "wh", "bias", "class_w", "class_b", "word_w", "word_b")

    def __init__(self, counts: np.ndarray, classes: int = 48, width: int = 24, seed: int = 3):
        rng = np.random.default_rng(seed)
        v, self.width = len(counts), width
        self.firsts = make_classes(counts, classes)
        self.class_of = np.repeat(np.arange(len(self.firsts) - 1, dtype=np.int16), np.diff(self.firsts))
        share = (counts + 1.0) / (counts + 1.0).sum()
        by_class = np.add.reduceat(share, self.firsts[:-1])
        f = np.float32
        self.embed = rng.normal(0, 0.1, (v, width)).astype(f)
        self.wx = rng.normal(0, width**-0.5, (width, 3 * width)).astype(f)
        self.wh = rng.normal(0, width**-0.5, (width, 3 * width)).astype(f)
        self.bias = np.zeros(3 * width, dtype=f)
        self.class_w = rng.normal(0, 0.01, (width, len(by_class))).astype(f)
        self.word_w = rng.normal(0, 0.01, (v, width)).astype(f)
        # without any training it predicts the counts' shares
        self.class_b, self.word_b = np.log(by_class).astype(f), np.log(share / by_class[self.class_of]).astype(f)
        self.step, self.moments = 0, None

    def weights(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def set_weights(self, values: list[np.ndarray]) -> None:
        for n, x in zip(self.NAMES, values, strict=True):
            setattr(self, n, np.array(x, dtype=np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.weights()])

    def set_flat(self, flat: np.ndarray) -> None:
        cuts = np.cumsum([x.size for x in self.weights()])[:-1]
        self.set_weights([x.reshape(w.shape) for x, w in zip(np.split(flat, cuts), self.weights(), strict=True)])

    def _step(self, gx: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Gates z and r, candidate n, the state's part of n, and the next state; a column for each stream."""
        w = self.width
        gh = self.wh.T @ h
        zr = gh[: 2 * w]
        zr += gx[: 2 * w]
        zr *= 0.5  # the logistic function by the hyperbolic tangent
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        z, r, own = zr[:w], zr[w:], gh[2 * w :]
        n = r * own
        n += gx[2 * w :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return z, r, n, own, new

    def _segments(self, c: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Positions ordered by class, and (class, from, to) of each run."""
        order = np.argsort(c, kind="stable")
        ends = np.cumsum(np.bincount(c, minlength=len(self.firsts) - 1))
        return order, [(k, int(a), int(b)) for k, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)) if b > a]

    def log_probs(self, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logarithms for rows of states and their next tokens."""
        c = self.class_of[targets]
        order, runs = self._segments(c)
        hs, goals = h[order], targets[order]  # a class's rows lie together
        out = np.empty(len(c))
        logits = hs @ self.class_w
        logits += self.class_b
        mine = logits[np.arange(len(c)), c[order]].astype(np.float64)
        mine -= _log_sum(logits)
        for k, a, b in runs:
            lo, hi = self.firsts[k], self.firsts[k + 1]
            if hi - lo == 1:
                continue
            logits = hs[a:b] @ self.word_w[lo:hi].T
            logits += self.word_b[lo:hi]
            mine[a:b] += logits[np.arange(b - a), goals[a:b] - lo]
            mine[a:b] -= _log_sum(logits)
        out[order] = mine
        return out

    def score(self, texts: list[np.ndarray], start: int, together: int = 256, window: int = 48) -> np.ndarray:
        """The log probability of each whole text.

        Texts are dealt to streams that run side by side, the longest first and each to the shortest stream, one after
        another; the state goes on from window to window and begins anew with each text, before which comes ``start``.
        """
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        out = np.zeros(len(texts))
        streams = [(0, k, []) for k in range(min(together, len(texts)))]
        for i in sorted(range(len(texts)), key=lambda i: (-lengths[i], i)):
            if lengths[i]:
                n, k, held = heapq.heappop(streams)
                held.append(i)
                heapq.heappush(streams, (n + int(lengths[i]), k, held))
        streams = sorted([(-n, k, held) for n, k, held in streams if n])
        if not streams:
            return out
        most = -streams[0][0]
        size = np.array([-n for n, _, _ in streams])
        goal, owner = np.zeros((len(streams), most), dtype=np.int32), np.full((len(streams), most), -1, dtype=np.int32)
        before, fresh = np.full((len(streams), most), start, dtype=np.int32), np.zeros((len(streams), most), dtype=bool)
        for k, (n, _, held) in enumerate(streams):
            ends = np.cumsum(lengths[held])
            goal[k, :-n] = np.concatenate([texts[i] for i in held])
            owner[k, :-n] = np.repeat(held, lengths[held])
            before[k, 1:] = goal[k, :-1]
            begins = np.append(0, ends[:-1])
            fresh[k, begins], before[k, begins] = True, start
        table = self.embed @ self.wx + self.bias
        h = np.zeros((self.width, len(streams)), dtype=np.float32)
        for lo in range(0, most, window):
            k = int((size > lo).sum())  # streams that go on
            part = slice(lo, min(most, lo + window))
            seen = np.ascontiguousarray(before[:k, part].T)
            begun, h = fresh[:k, part].T, np.ascontiguousarray(h[:, :k])
            states = np.empty((len(seen), k, self.width), dtype=np.float32)
            for t, any_begins in enumerate(begun.any(axis=1).tolist()):  # step by step, so that a step's numbers stay in the cache
                if any_begins:
                    h[:, begun[t]] = 0
                h = self._step(table[seen[t]].T, h)[4]
                states[t] = h.T
            of = owner[:k, part].T.ravel()
            rows = states.reshape(-1, self.width)
            if not (of >= 0).all():
                rows = rows[of >= 0]
            got = self.log_probs(rows, goal[:k, part].T.ravel()[of >= 0])
            out += np.bincount(of[of >= 0], weights=got, minlength=len(texts))
        return out

    def _loss_grads(self, h: np.ndarray, targets: np.ndarray, grads: dict[str, np.ndarray]) -> np.ndarray:
        """Adds the output's gradients and returns that of the states."""
        n, c = len(targets), self.class_of[targets]
        order, runs = self._segments(c)
        hs, goals = h[order], targets[order]
        p = _shares(hs @ self.class_w + self.class_b)
        p[np.arange(n), c[order]] -= 1
        grads["class_w"] += hs.T @ p
        grads["class_b"] += np.ones(n, dtype=np.float32) @ p
        dhs = p @ self.class_w.T
        for k, a, b in runs:
            lo, hi = self.firsts[k], self.firsts[k + 1]
            if hi - lo == 1:
                continue
            p = _shares(hs[a:b] @ self.word_w[lo:hi].T + self.word_b[lo:hi])
            p[np.arange(b - a), goals[a:b] - lo] -= 1
            grads["word_w"][lo:hi] += p.T @ hs[a:b]
            grads["word_b"][lo:hi] += np.ones(b - a, dtype=np.float32) @ p
            dhs[a:b] += p @ self.word_w[lo:hi]
        dh = np.empty_like(dhs)
        dh[order] = dhs
        return dh

    def train(self, tokens: np.ndarray, start: int, streams: int = 192, window: int = 48, rate: float = 1.2e-2) -> None:
        """Truncated backpropagation over a run of tokens, every one of them once; Adam's moments go on from run to run.

        The run is cut into streams that keep their state from window to window, as many as leave each some windows; what
        the division leaves over is a short stream of its own.
        """
        streams = int(min(streams, max(1, len(tokens) // (8 * window))))
        length = len(tokens) // streams
        if length:
            self._train(tokens[: length * streams].reshape(streams, length), start, window, rate)
        if length * streams < len(tokens):
            self._train(tokens[length * streams :].reshape(1, -1), start, window, rate)

    def _train(self, goal: np.ndarray, start: int, window: int, rate: float) -> None:
        streams, length = goal.shape
        prev = np.concatenate([np.full((streams, 1), start), goal[:, :-1]], axis=1)
        h, w = np.zeros((self.width, streams), dtype=np.float32), self.width
        most = min(length, window)
        kept = [np.empty((most, w, streams), dtype=np.float32) for _ in range(5)]
        kept_rows, to_embed = (np.empty((most, streams, w), dtype=np.float32) for _ in range(2))
        dgx, dgh = (np.empty((3 * w, streams), dtype=np.float32) for _ in range(2))
        # all that can be is done step by step, so that a step's numbers stay in the cache
        for lo in range(0, length, window):
            xs, ys = (np.ascontiguousarray(a[:, lo : lo + window].T) for a in (prev, goal))
            seen, states = self.embed[xs], kept_rows[: len(xs)]
            before, z, r, n, own = kept
            for t in range(len(xs)):
                gx = self.wx.T @ seen[t].T
                gx += self.bias[:, None]
                before[t] = h
                z[t], r[t], n[t], own[t], h = self._step(gx, h)
                states[t] = h.T
            grads = {name: np.zeros_like(x) for name, x in zip(self.NAMES, self.weights(), strict=True)}
            dhs = self._loss_grads(states.reshape(-1, w), ys.reshape(-1), grads).reshape(len(xs), streams, w)
            carry = np.zeros_like(h)
            for t in range(len(xs) - 1, -1, -1):
                carry += dhs[t].T
                d, dn, zs, rs, ns = carry, dgx[2 * w :], z[t], r[t], n[t]
                rest = 1 - zs
                np.multiply(ns, ns, out=dn)
                np.subtract(1, dn, out=dn)
                dn *= rest
                dn *= d
                dz = np.subtract(before[t], ns, out=dgx[:w])
                dz *= zs
                dz *= rest
                dz *= d
                dr = np.subtract(1, rs, out=dgx[w : 2 * w])
                dr *= rs
                dr *= own[t]
                dr *= dn
                dgh[: 2 * w] = dgx[: 2 * w]
                np.multiply(dn, rs, out=dgh[2 * w :])
                grads["wh"] += before[t] @ dgh.T
                grads["wx"] += seen[t].T @ dgx.T
                grads["bias"] += dgx.sum(axis=1)
                np.matmul(dgx.T, self.wx.T, out=to_embed[t])
                carry = self.wh @ dgh
                d *= zs
                carry += d
            x = xs.reshape(-1)
            order = np.argsort(x, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], x[order][1:] != x[order][:-1]]))
            grads["embed"][x[order][cut]] = np.add.reduceat(to_embed[: len(xs)].reshape(-1, w)[order], cut)
            self._adam(grads, rate, x.size)

    def _adam(self, grads: dict[str, np.ndarray], rate: float, size: int) -> None:
        if self.moments is None:
            self.moments = {n: (np.zeros_like(x), np.zeros_like(x)) for n, x in zip(self.NAMES, self.weights(), strict=True)}
        self.step += 1
        for name, x in zip(self.NAMES, self.weights(), strict=True):
            g, (first, second) = grads[name], self.moments[name]
            g *= np.float32(1 / size)
            np.clip(g, -1, 1, out=g)
            first *= 0.9
            first += np.float32(0.1) * g
            g *= g
            second *= 0.99
            second += np.float32(0.01) * g
            np.multiply(second, np.float32(1 / (1 - 0.99**self.step)), out=g)
            np.sqrt(g, out=g)
            g += np.float32(1e-6)
            np.divide(first, g, out=g)
            g *= np.float32(rate / (1 - 0.9**self.step))
            x -= g


def _log_sum(logits: np.ndarray) -> np.ndarray:
    """The logarithm of the sum of the rows' exponentials; ``logits`` is used up."""
    top = logits.max()
    if top > 60:  # otherwise no exponential is too large
        high = logits.max(axis=1)
        logits -= high[:, None]
        return high + np.log(np.exp(logits, out=logits).sum(axis=1, dtype=np.float64))
    return np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], dtype=np.float32)).astype(np.float64)


def _shares(logits: np.ndarray) -> np.ndarray:
    if logits.max() > 60:
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= (logits @ np.ones(logits.shape[1], dtype=np.float32))[:, None]
    return logits
