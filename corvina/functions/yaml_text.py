"""YAML texts as JSON: the part of the language that records are written in.

Block mappings and sequences, nested by indentation; flow lists and mappings on one line; plain, single- and double-quoted
scalars; literal and folded blocks with their chomping marks; comments, document markers. Plain scalars are null, booleans,
integers and floats by YAML's core rules, else strings. Anchors, aliases, tags, complex keys and several documents in one
text are errors, as is anything else that can't be read.
"""

from __future__ import annotations

import json
import re
from typing import Any

# Plain scalars with a meaning.
WORDS = {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "\\": "\\", '"': '"', "/": "/", "b": "\b", "f": "\f", "e": "\x1b", " ": " "}
INTEGER, FLOAT = re.compile(r"[-+]?\d+"), re.compile(r"[-+]?(\d+\.\d*|\.\d+|\d+)([eE][-+]?\d+)?")
KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\-?:,\[\]{}#&*!|>'"%@`][^#]*?|[-?:][^\s#][^#]*?)\s*:(?:\s+|$)""")


class YamlError(ValueError):
    pass


def _plain(text: str) -> Any:
    if text in WORDS:
        return WORDS[text]
    if INTEGER.fullmatch(text):
        return int(text)
    if FLOAT.fullmatch(text):
        return float(text)
    if text[0] in "&*!%@`|>":
        raise YamlError(f"not supported: {text[:40]}")
    return text


class _Flow:
    """Scalars and flow collections of one line."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def blanks(self) -> None:
        while self.at < len(self.text) and self.text[self.at] in " \t":
            self.at += 1

    def quoted(self) -> str:
        mark, out = self.text[self.at], []
        self.at += 1
        while self.at < len(self.text):
            c = self.text[self.at]
            if mark == "'" and self.text[self.at : self.at + 2] == "''":
                out.append("'")
                self.at += 2
            elif c == mark:
                self.at += 1
                return "".join(out)
            elif mark == '"' and c == "\\":
                c = self.text[self.at + 1 : self.at + 2]
                width = {"x": 2, "u": 4, "U": 8}.get(c)
                if width:
                    out.append(chr(int(self.text[self.at + 2 : self.at + 2 + width], 16)))
                elif c in ESCAPES:
                    out.append(ESCAPES[c])
                else:
                    raise YamlError(f"unknown escape \\{c}")
                self.at += 2 + (width or 0)
            else:
                out.append(c)
                self.at += 1
        raise YamlError("a quote has no end")

    def value(self, ends: str) -> Any:
        self.blanks()
        c = self.text[self.at : self.at + 1]
        if c in ("'", '"') and c:
            return self.quoted()
        if c in ("[", "{") and c:
            return self.collection(c)
        start = self.at
        while self.at < len(self.text) and self.text[self.at] not in ends:
            if self.text[self.at] == ":" and "}" in ends and self.text[self.at + 1 : self.at + 2] in (" ", "", ",", "}"):
                break
            self.at += 1
        return _plain(self.text[start : self.at].strip())

    def collection(self, open_: str) -> Any:
        close, out = ("]", []) if open_ == "[" else ("}", {})
        self.at += 1
        while True:
            self.blanks()
            if self.text[self.at : self.at + 1] == close:
                self.at += 1
                return out
            if self.at >= len(self.text):
                raise YamlError("a flow collection has no end on its line")
            one = self.value(",]" if open_ == "[" else ",}")
            self.blanks()
            if open_ == "[":
                out.append(one)
            elif self.text[self.at : self.at + 1] == ":":
                self.at += 1
                out[_name(one)] = self.value(",}")
            else:
                out[_name(one)] = None
            self.blanks()
            if self.text[self.at : self.at + 1] == ",":
                self.at += 1
            elif self.text[self.at : self.at + 1] != close:
                raise YamlError("a comma is missing")


def _name(key: Any) -> str:
    return key if isinstance(key, str) else json.dumps(key)


def _uncommented(text: str) -> str:
    """A line without its comment: a number sign at the start or after a blank, outside quotes."""
    quote = ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote and not (quote == '"' and text[i - 1] == "\\") else quote
        elif c in "'\"" and (i == 0 or text[i - 1] in " [{,:-"):
            quote = c
        elif c == "#" and (i == 0 or text[i - 1] in " \t"):
            return text[:i].rstrip()
    return text.rstrip()


class _Block:
    def __init__(self, text: str):
        lines = text.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.raw, self.at = lines, 0

    def peek(self) -> tuple[int, str] | None:
        """Indentation and content of the next line that has any."""
        while self.at < len(self.raw):
            line = self.raw[self.at]
            body = line.lstrip(" ")
            told = _uncommented(body)
            if told and not (told == "---" and len(body) == len(line) and not any(_uncommented(x.strip()) for x in self.raw[: self.at])):
                if told in ("---", "...") and len(body) == len(line):
                    if told == "..." or not any(x.strip() for x in self.raw[self.at + 1 :]):
                        self.at = len(self.raw)
                        return None
                    raise YamlError("several documents in one text")
                if body.startswith("\t"):
                    raise YamlError("a tab indents a line")
                return len(line) - len(body), told
            self.at += 1
        return None

    def node(self, least: int) -> Any:
        seen = self.peek()
        if seen is None or seen[0] < least:
            return None
        indent, told = seen
        if told == "-" or told.startswith("- "):
            return self.sequence(indent)
        if KEY.match(told):
            return self.mapping(indent)
        self.at += 1
        return self.scalar(told, indent - 1)

    def scalar(self, told: str, indent: int) -> Any:
        """A value that began on a line just read; more deeply indented lines go on with it."""
        if re.fullmatch(r"[|>][-+]?\d?[-+]?", told):
            return self.literal(told, indent)
        if told[0] in "'\"[{":
            flow = _Flow(told)
            value = flow.value("")
            if flow.text[flow.at :].strip():
                raise YamlError(f"more after a value: {told[:40]}")
            return value
        while (seen := self.peek()) and seen[0] > indent:
            told = f"{told} {seen[1]}"
            self.at += 1
        if re.search(r":(\s|$)", told):
            raise YamlError(f"a mapping inside a value: {told[:40]}")
        return _plain(told)

    def literal(self, mark: str, indent: int) -> str:
        lines = []
        own = int(d.group()) + max(indent, 0) if (d := re.search(r"\d", mark)) else None
        while self.at < len(self.raw):
            line = self.raw[self.at]
            depth = len(line) - len(line.lstrip(" "))
            if line.strip():
                if own is None:
                    own = depth
                if depth < own or depth <= indent:
                    break
            lines.append(line[own:] if own is not None and line.strip() else "")
            self.at += 1
        while lines and not lines[-1]:
            lines.pop()
            if "+" in mark:
                return "\n".join([*lines, "", ""])
        if mark[0] == ">":
            # a single line break becomes a blank, empty lines become breaks; indented lines keep theirs
            out, before, empty = "", "", 0
            for x in lines:
                if x:
                    kept = before and (before[0] == " " or x[0] == " ")
                    out += ("\n" * (empty + 1) if kept else "\n" * empty if empty or not before else " ") + x
                    before, empty = x, 0
                else:
                    empty += 1
        else:
            out = "\n".join(lines)
        return out if "-" in mark or not lines else out + "\n"

    def sequence(self, indent: int) -> list:
        out = []
        while (seen := self.peek()) and seen[0] == indent and (seen[1] == "-" or seen[1].startswith("- ")):
            rest = seen[1][1:].lstrip(" ")
            if not rest:
                self.at += 1
                out.append(self.node(indent + 1))
            elif rest.startswith("- ") or KEY.match(rest):
                # what follows the dash is a block of its own, indented by its column
                line = self.raw[self.at]
                column = indent + 1 + (len(line[indent + 1 :]) - len(line[indent + 1 :].lstrip(" ")))
                self.raw[self.at] = " " * column + line[column:]
                out.append(self.node(column))
            else:
                self.at += 1
                out.append(self.scalar(rest, indent))
        if seen and seen[0] > indent:
            raise YamlError(f"a line is indented too far: {seen[1][:40]}")
        return out

    def mapping(self, indent: int) -> dict:
        out: dict[str, Any] = {}
        while (seen := self.peek()) and seen[0] == indent and (m := KEY.match(seen[1])):
            flow = _Flow(m.group(1))
            key = _name(flow.quoted() if m.group(1)[0] in "'\"" else _plain(m.group(1)))
            rest = seen[1][m.end() :].strip()
            self.at += 1
            if rest:
                out[key] = self.scalar(rest, indent)
            else:
                below = self.peek()
                # a sequence may stand at its key's own indentation
                dashed = below is not None and below[0] == indent and (below[1] == "-" or below[1].startswith("- "))
                out[key] = self.node(indent if dashed else indent + 1)
        if seen and (seen[0] > indent or (seen[0] == indent and not seen[1].startswith("-"))):
            raise YamlError(f"no key: {seen[1][:40]}")
        return out


def parse_yaml(text: str) -> Any:
    block = _Block(text)
    value = block.node(0)
    if (left := block.peek()) is not None:
        raise YamlError(f"more after the document: {left[1][:40]}")
    return value


def yaml_to_json(text: str | None) -> str | None:
    """A YAML text as JSON, or null if it can't be read."""
    if text is None:
        return None
    try:
        return json.dumps(parse_yaml(text), ensure_ascii=False)
    except (YamlError, ValueError, IndexError, RecursionError):
        return None
