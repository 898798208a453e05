"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is one token that its encoding ends with. An automaton over all tokens' strings lists the
tokens that end at each position; of these the right one is the token that is compatible with the last token of the
prefix before it. Two neighbouring tokens are compatible if no merge across their border would have come before the
merges that made them: their merges are taken back, latest first, and the pairs at the border are looked up. Following
the stored tokens from the end of the word back to its start gives exactly the ids of merging by rank.

Words are pieces of the tokenizer file's own pattern. Each process keeps the results of words that it has met, up to a
bound.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.encoding import byte_characters

#: Texts of other characters (on which Unicode versions differ), or with capital sigma, go through the library's
#: normaliser and pattern; the merges stay here.
_UNSURE = re.compile(r"[^\u0000-΢Τ-ԯ -⁯]")
_LAST = 256  # added to the code of a word's last byte where tokens carry an end-of-word mark


class PrefixBPE:
    def __init__(self, path: str, most_words: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("only plain BPE files")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("only added tokens that are found as they are")
        self.decoder = (spec.get("decoder") or {}).get("type")
        if self.decoder not in (None, "ByteLevel"):
            raise ValueError("only files with a byte-level decoder or none")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        self._text_steps(spec, path)
        byte = self.byte = _byte_values()

        def form(token: str) -> str:
            end = bool(self.suffix) and token.endswith(self.suffix)
            chars = [byte[c] for c in (token[: -len(self.suffix)] if end else token)]
            if end:
                chars[-1] += _LAST
            return "".join(map(chr, chars))

        forms = {i: form(t) for t, i in model["vocab"].items() if i not in self.added.values()}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = dict.fromkeys(forms, -1)
        self.pair_rank: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair = model["vocab"][a], model["vocab"][b]
            whole = model["vocab"][a + b]
            if whole in self.parts:
                raise ValueError("two merges make the same token")
            self.parts[whole], self.rank[whole], self.pair_rank[pair] = pair, rank, rank
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for i, s in forms.items():
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.most, self.words, self.pairs = most_words, {}, {}

    def _text_steps(self, spec: dict, path: str) -> None:
        from tokenizers import Tokenizer

        pre = spec["pre_tokenizer"]
        steps = pre["pretokenizers"] if pre["type"] == "Sequence" else [pre]
        norms = spec.get("normalizer")
        norms = [] if norms is None else norms["normalizers"] if norms["type"] == "Sequence" else [norms]
        self.norms = [n["type"] for n in norms]
        self.library = Tokenizer.from_file(path)
        split = next((s for s in steps if s["type"] == "Split"), None)
        known = self.norms == ["NFC", "Replace", "Lowercase"] and split is not None and split["invert"] and split["behavior"] == "Removed"
        # the bounded pattern takes words of letters apart from the rest, as the file's own pattern does
        self.pattern = regex.compile(split["pattern"]["Regex"], regex.V0) if known else None
        self.added_pattern = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether a then b stay two tokens when what they spell is merged by rank."""
        if (known := self.pairs.get((a, b))) is not None:
            return known
        rank, parts = self.rank, self.parts
        left, right, before = a, b, len(parts) + 1
        while True:
            # a merge of the tokens at the border happens if its turn comes before those already taken back
            if self.pair_rank.get((left, right), before) < before:
                answer = False
                break
            if rank[left] < 0 and rank[right] < 0:
                answer = True
                break
            # take back the later of the two merges; of equal ones the right one, for merges run from left to right
            if rank[left] > rank[right]:
                before, left = rank[left], parts[left][1]
            else:
                before, right = rank[right] + 1, parts[right][0]
        if len(self.pairs) > 3_000_000:
            self.pairs.clear()
        self.pairs[a, b] = answer
        return answer

    def encode_bytes(self, word: bytes) -> list[int]:
        s = word.decode("latin-1")
        if self.suffix:
            s = s[:-1] + chr(ord(s[-1]) + _LAST)
        last: list[tuple[int, int] | None] = [None] * (len(s) + 1)
        for end, (token, n) in self.automaton.iter(s):
            if last[end + 1] is None:
                start = end + 1 - n
                if not start or ((before := last[start]) is not None and self.compatible(before[0], token)):
                    last[end + 1] = (token, n)
        ids, at = [], len(s)
        while at:
            token, n = last[at]
            ids.append(token)
            at -= n
        return ids[::-1]

    def _split(self, text: str) -> list[bytes] | list[str]:
        """The words of a stretch without added tokens, as byte strings or as strings to be encoded as UTF-8."""
        if self.pattern is None or _UNSURE.search(text):
            lib = self.library
            text = lib.normalizer.normalize_str(text) if lib.normalizer else text
            byte = _byte_values()
            return [bytes(byte[c] for c in w) for w, _ in lib.pre_tokenizer.pre_tokenize_str(text)]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return self.pattern.findall(text.lower())

    def _word(self, word: bytes | str) -> tuple[int, str, str]:
        """(number of ids, ids as text, tokens as text) of a word."""
        ids = self.encode_bytes(word if isinstance(word, bytes) else word.encode("utf-8"))
        out = len(ids), " ".join(map(str, ids)), self.decode(ids)
        if len(self.words) > self.most:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = out
        return out

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by blanks, decoded text) of a whole text."""
        stretches = self.added_pattern.split(text) if self.added_pattern else [text]
        found = []
        for n, stretch in enumerate(stretches):
            if n % 2:
                found.append((1, str(self.added[stretch]), stretch))
            elif stretch:
                get = self.words.get
                words = self._split(stretch)
                found.extend([get(w) or self._word(w) for w in words])
        between = "" if self.decoder else " "  # words are whole characters, so their decoded texts can be put together
        return sum(f[0] for f in found), " ".join([f[1] for f in found]), between.join([f[2] for f in found])

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.digest(text)[1].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks for files that name no decoder, else the text of their bytes; unknown ids are left out."""
        if not self.decoder:
            return " ".join(self.names[i] for i in ids if i in self.names)
        raw = [self.names[i].encode() if i in self.added.values() else bytes(map(self.byte.__getitem__, self.names[i])) for i in ids if i in self.names]
        return b"".join(raw).decode("utf-8", "replace")


def _byte_values() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_characters())}


_TOOLS: dict[str, PrefixBPE] = {}


def tool(path: str) -> PrefixBPE:
    if path not in _TOOLS:
        _TOOLS[path] = PrefixBPE(path)
    return _TOOLS[path]


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256) for each row of docs; with ``keep`` also ids and decoded.

    Null and empty texts have no ids and decode to an empty text. Special tokens in a text become their ids. Repeated rows
    each get a row. An empty table gives an empty result. Only the two named columns are read; ``tokenizer`` is a path
    that executors can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tool(tokenizer)
        for b in batches:
            got = [bpe.digest(t or "") for t in b.column(1).to_pylist()]
            sha = [[hashlib.sha256(g[k].encode("utf-8", "surrogatepass")).hexdigest() for g in got] for k in (1, 2)]
            columns = [b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array(sha[0]), pa.array(sha[1])]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                columns += [pa.array([[int(x) for x in g[1].split()] for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got])]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
