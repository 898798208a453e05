"""Token ids of whole texts from the tokenizers library, asking it once for each piece that repeats.

Two kinds of tokenizer file allow texts to be cut at blanks without changing an id:

- byte-level ones whose pattern takes one blank along with what follows: a text may be cut before a blank that a
  non-blank follows;
- lower-casing ones that drop white space: a text may be cut at all white space.

Pieces are numbered in a dictionary, and each new piece goes to the library once: a piece of plain letters, digits and
punctuation straight to the library's model, which is several times as fast as its whole chain, any other through the
chain. A text whose cut isn't certain (runs of blanks, special tokens in the text as it is or in lower case, characters
on which Unicode versions differ) is encoded whole by the library, as are all texts of any other kind of tokenizer.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

#: Texts of other characters, or with capital sigma, whose lower case depends on its neighbours, aren't cut.
_UNSURE = re.compile(r"[^\u0000-\u001b -΢Τ-ԯ -⁯]")
#: What both kinds' patterns part alike: letters, digits, and others; an apostrophe may begin a word ending and isn't here.
_LETTERS, _OTHERS = "[A-Za-zÀ-ÖØ-öø-ɏ]+", "[!-&(-/:-@\\[-`{-~¡«»¿‐-‧‰-›]+"
_PARTS = {"blanks": re.compile(f"{_LETTERS}|[0-9]+|{_OTHERS}"), "lower": re.compile(f"{_LETTERS}|[0-9]|{_OTHERS}")}


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level files: itself if printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class _Numbers(dict):
    """Numbers the keys that it is asked for, and keeps the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class Encoder:
    def __init__(self, path: str, most_pieces: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        blanks = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm
        steps = [x.get("type") for x in norm.get("normalizers", [])]
        kinds = [x.get("type") for x in pre.get("pretokenizers", [])]
        lower = steps == ["NFC", "Replace", "Lowercase"] and kinds == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["behavior"] == "Removed"
        plain = bool(self.special) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
        self.kind = "blanks" if blanks and plain else "lower" if lower and plain else "whole"
        if self.kind != "whole":
            self.mark, self.mark_id = self.special[0], self.library.token_to_id(self.special[0])
            self.model, self.parts, self.shown = self.library.model, _PARTS[self.kind], byte_characters()
            self.lead = self.shown[32] if self.kind == "blanks" else ""
        self.most = most_pieces
        self._reset()

    def _reset(self) -> None:
        self.numbers, self.heads = _Numbers(), {}
        self.length, self.offset, self.flat, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _learn(self) -> None:
        """Ids of the new pieces; a piece that can't be cut off has length -1."""
        new = self.numbers.new
        self.numbers.new = []
        first, total = len(self.numbers) - len(new), len(self.numbers)
        if total > len(self.length):
            grow = max(total, 2 * len(self.length))
            self.length, self.offset = np.resize(self.length, grow), np.resize(self.offset, grow)
        lead = " " if self.kind == "blanks" else ""
        self.length[first:total] = -1
        direct, at_n, sizes, good = [], [], [], []
        for n, p in enumerate(new, first):
            if (ids := self._direct(p)) is not None:
                direct += ids
                at_n.append(n)
                sizes.append(len(ids))
            elif not lead or (p and not p[0].isspace()):  # what starts with a blank belongs to the blanks before it
                good.append((n, p))
        if at_n:
            sizes = np.array(sizes)
            self._keep(np.array(at_n), np.cumsum(sizes) - sizes, sizes, np.array(direct, dtype=np.uint32))
        for at in range(0, len(good), 1_000):
            some = good[at : at + 1_000]
            ids = self.whole(self.mark.join([lead + p for _, p in some]))
            cut = np.flatnonzero(ids == self.mark_id)
            start, end = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(ids)]])
            self._keep(np.array([n for n, _ in some]), start, end - start, ids)

    def _direct(self, piece: str) -> list[int] | None:
        """A piece's ids from the model alone; None where the chain's pattern might part it otherwise."""
        parts = self.parts.findall(piece)
        if not parts or sum(map(len, parts)) != len(piece):
            return None
        if not piece.isascii():
            parts = ["".join([self.shown[b] for b in x.encode()]) for x in parts]
        parts[0] = self.lead + parts[0]
        return [t.id for x in parts for t in self.model.tokenize(x)]

    def _keep(self, numbers: np.ndarray, start: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, max(self.used + len(ids), 2 * len(self.flat)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.length[numbers], self.offset[numbers] = sizes, self.used + start
        self.used += len(ids)

    def _has_special(self, text: str) -> bool:
        if self.kind == "lower":  # pieces are looked at in lower case, in which they must not look special either
            text = text + "\n" + text.lower()
        return any(s in text for s in self.special)

    def _pieces(self, text: str) -> tuple[str, list[str]] | None:
        """The piece without a blank before it, and the others; None where the text must stay whole."""
        if _UNSURE.search(text):
            return None
        if self.kind == "blanks":
            first, *rest = text.split(" ")
            return first, rest
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return "", text.lower().split()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        if self.kind == "whole":
            return [self.whole(t) for t in texts]
        if len(self.numbers) > self.most or len(self.heads) > self.most // 8:
            self._reset()
        plans = []
        for text in texts:
            cut = None if self._has_special(text) else self._pieces(text)
            if cut is None:
                plans.append(None)
                continue
            head, rest = cut
            plans.append((head, np.fromiter(map(self.numbers.__getitem__, rest), dtype=np.int64, count=len(rest))))
        if self.numbers.new:
            self._learn()
        out = []
        for text, p in zip(texts, plans, strict=True):
            if p is None or (p[1].size and self.length[p[1]].min() < 0):
                out.append(self.whole(text))
                continue
            head, k = p
            ids = self._gather(k)
            if head:
                if (h := self.heads.get(head)) is None:
                    h = self.heads[head] = self.whole(head)
                ids = np.concatenate([h, ids])
            out.append(ids)
        return out

    def _gather(self, k: np.ndarray) -> np.ndarray:
        n = self.length[k]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(n) else 0
        return self.flat[np.repeat(self.offset[k] - (ends - n), n) + np.arange(total)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder of a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
